"""Images: PNG read into pixels, and rasters of floats as GeoTIFF. Each holds one image on the driver."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes after PNG's five row filters are undone."""
    rows = np.frombuffer(raw, np.uint8)[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = int(rows[y, 0]), rows[y, 1:]
        if kind == 0:
            got = line
        elif kind == 1:
            got = np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            got = line + above
        else:
            b = bytearray(line.tobytes())
            for i in range(stride):
                left = b[i - step] if i >= step else 0
                up = int(above[i])
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    corner = int(above[i - step]) if i >= step else 0
                    guess = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
                b[i] = (b[i] + guess) & 255
            got = np.frombuffer(bytes(b), np.uint8)
        out[y] = above = got
    return out


def read_png(spark: SparkSession, path: str) -> DataFrame:
    """px, py, red, green, blue, alpha of a PNG image of 8 bits a channel; py counts upwards. Grey images have equal colours, opaque ones alpha 255."""
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError(f"{path} is not a PNG image")
    at, body, shape = 8, [], None
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, chunk = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + n
    if shape is None or shape[2] != 8 or shape[3] not in _CHANNELS or shape[6]:
        raise ValueError(f"{path}: only images of 8 bits a channel, without palette or interlacing, are read")
    width, height, _, colour = shape[:4]
    c = _CHANNELS[colour]
    image = _unfiltered(zlib.decompress(b"".join(body)), height, width * c, c).reshape(height, width, c)[::-1]
    full = np.full((height, width), 255, np.uint8)
    rgb = [image[:, :, k if c > 2 else 0] for k in range(3)]
    alpha = image[:, :, c - 1] if c in (2, 4) else full
    py, px = np.mgrid[0:height, 0:width]
    names = ("px", "py", "red", "green", "blue", "alpha")
    cols = [px.ravel().astype(np.int64), py.ravel().astype(np.int64), *[x.ravel().astype(np.int16) for x in (*rgb, alpha)]]
    return spark.createDataFrame(pa.table(dict(zip(names, cols, strict=True))))


#: EPSG codes of UTM zones are a base and the zone, by datum and hemisphere.
UTM = {("WGS84", False): 32600, ("WGS84", True): 32700, ("GDA94", True): 28300, ("NAD83", False): 26900, ("ETRS89", False): 25800}


def epsg_of(projection: dict[str, str]) -> int | None:
    """The EPSG code that a projection file's entries mean: epsg or init say it, else a UTM zone and its datum."""
    said = projection.get("epsg") or projection.get("init", "").rpartition(":")[2]
    if said.isdigit():
        return int(said)
    if projection.get("proj") == "utm" and projection.get("zone", "").isdigit():
        base = UTM.get((projection.get("datum", "WGS84"), "south" in projection))
        return base + int(projection["zone"]) if base else None
    return None


def write_geotiff(raster: DataFrame, path: str, width: int, height: int, pixel: float, origin: tuple[float, float], projection: dict[str, str] | None = None, empty: float = float("nan")) -> None:
    """A one-channel float32 GeoTIFF of px, py, value (py upwards) on the driver's disk; origin is the lower left corner."""
    image = np.full((height, width), empty, "<f4")
    for r in raster.where(f"px >= 0 and px < {width} and py >= 0 and py < {height}").select("px", "py", "value").toLocalIterator():
        image[height - 1 - r.py, r.px] = r.value
    epsg = epsg_of(projection or {})
    # Key, place, count, value: model (1 projected, 32767 own), pixels are areas, the code of the projection.
    keys = [(1024, 0, 1, 1 if epsg else 32767), (1025, 0, 1, 1)] + ([(3072, 0, 1, epsg)] if epsg else [])
    shorts = [1, 1, 0, len(keys), *[v for k in keys for v in k]]
    scale, tie = (pixel, pixel, 0.0), (0.0, 0.0, 0.0, origin[0], origin[1] + height * pixel, 0.0)
    extra = [(33550, 12, 3, struct.pack("<3d", *scale)), (33922, 12, 6, struct.pack("<6d", *tie)), (34735, 3, len(shorts), struct.pack(f"<{len(shorts)}H", *shorts))]
    plain = [(256, 4, width), (257, 4, height), (258, 3, 32), (259, 3, 1), (262, 3, 1), (273, 4, 0), (277, 3, 1), (278, 4, height), (279, 4, image.nbytes), (339, 3, 3)]
    at = 8 + 2 + 12 * (len(plain) + len(extra)) + 4
    entries, tail = [], b""
    for tag, kind, n, raw in extra:
        entries.append(struct.pack("<HHII", tag, kind, n, at + len(tail)))
        tail += raw
    first = at + len(tail)
    head = [struct.pack("<HHII", tag, kind, 1, first if tag == 273 else v) for tag, kind, v in plain]
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHIH", b"II", 42, 8, len(head) + len(entries)) + b"".join(head + entries) + struct.pack("<I", 0) + tail + image.tobytes())


def read_geotiff(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """px, py, value of write_geotiff()'s kind of file, and its pixel, origin and epsg. Pixels that aren't numbers are left out."""
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    if data[:4] != b"II*\0":
        raise ValueError(f"{path} is not a little-endian TIFF file")
    (ifd,) = struct.unpack_from("<I", data, 4)
    (n,) = struct.unpack_from("<H", data, ifd)
    size = {3: "H", 4: "I", 12: "d"}
    tags = {}
    for k in range(n):
        tag, kind, count, value = struct.unpack_from("<HHII", data, ifd + 2 + 12 * k)
        if kind in size:
            width = struct.calcsize(size[kind]) * count
            tags[tag] = struct.unpack_from(f"<{count}{size[kind]}", data, value if width > 4 else ifd + 10 + 12 * k)
    if tags.get(259, (1,))[0] != 1 or tags.get(339, (1,))[0] != 3 or tags[258] != (32,) or len(tags[273]) != 1:
        raise ValueError(f"{path}: only one strip of uncompressed 32-bit floats is read")
    w, h = tags[256][0], tags[257][0]
    image = np.frombuffer(data, "<f4", w * h, tags[273][0]).reshape(h, w)[::-1]
    py, px = np.nonzero(~np.isnan(image))
    keys = tags.get(34735, ())
    code = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4)}
    pixel = tags[33550][0]
    about = {"pixel": pixel, "origin": (tags[33922][3], tags[33922][4] - h * pixel), "epsg": code.get(3072)}
    return spark.createDataFrame(pa.table({"px": px, "py": py, "value": image[py, px].astype(np.float64)})), about
