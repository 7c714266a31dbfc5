"""The canonical schema of a ray cloud and checks against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT_COLUMNS = ["sx", "sy", "sz", "ex", "ey", "ez"]
COLOURS = ["red", "green", "blue", "alpha"]
RAYS = T.StructType(
    [T.StructField("ray_id", T.LongType(), False)]
    + [T.StructField(c, T.DoubleType()) for c in (*POINT_COLUMNS, "time")]
    + [T.StructField(c, T.ShortType()) for c in COLOURS]
)
TRAJECTORY = "time double, x double, y double, z double"
MESH_VERTICES = "vid long, x double, y double, z double, red short, green short, blue short, alpha short"
MESH_FACES = "fid long, v0 long, v1 long, v2 long"
SEGMENTS = "tree_id long, seg_id int, x double, y double, z double, radius double, parent_id int, attrs map<string,double>"
TREES = "tree_id long, attrs map<string,double>"


def assert_rays(df: DataFrame) -> DataFrame:
    missing = [f.name for f in RAYS if f.name not in df.columns]
    if missing:
        raise ValueError(f"not a ray cloud, it lacks {', '.join(missing)}")
    return df


def bounded() -> Column:
    """True for rays that hit something."""
    return F.col("alpha") > 0


def loaded(rays: DataFrame, least: int = 4) -> DataFrame:
    """rays, if it is a ray cloud of at least `least` rays; reads no more of it than that takes."""
    n = assert_rays(rays).limit(least).count()
    if n < least:
        raise ValueError(f"a cloud of {n} rays; {least} are needed")
    return rays


def mapped(rays: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rays with new starts, ends, times or colours, each from the row's own old values; the schema stays."""
    kinds = {f.name: f.dataType for f in RAYS}
    unknown = set(columns) - set(kinds) | set(columns) & {"ray_id"}
    if unknown:
        raise ValueError(f"not a ray's to change: {', '.join(sorted(unknown))}")
    return assert_rays(rays).withColumns({k: c.cast(kinds[k]) for k, c in columns.items()})
