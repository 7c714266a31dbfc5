"""Text formats: trajectories, trees, trunks, points, projections. Parsing is done by column expressions, a line at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_trajectory(lines: DataFrame) -> DataFrame:
    """time, x, y, z, in order of time, from lines (value) of at least four numbers between spaces; % begins a comment."""
    p = F.split(F.trim("value"), r"\s+")
    x = lines.where("trim(value) <> '' and not startswith(trim(value), '%')")
    return x.select(*[F.get(p, k).cast("double").alias(n) for k, n in enumerate(("time", "x", "y", "z"))]).orderBy("time")


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    return parse_trajectory(spark.read.text(path))


def format_trajectory(trajectory: DataFrame) -> DataFrame:
    """Lines (value) of a trajectory file, without its comment."""
    return trajectory.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("time", "x", "y", "z")]).alias("value"))


def parse_trees(lines: DataFrame, header: str) -> DataFrame:
    """tree_id, seg_id, x, y, z, radius, parent_id, attrs, tree_attrs from lines (tree_id, value) and the header line.

    The header names attributes of trees, then x,y,z,radius, then those of segments; a line has the first once and the others again and
    again. parent_id is -1 where the header doesn't name it. A line of another length is an error.
    """
    names = [n.strip() for n in header.lstrip("#").split(",") if n.strip()]
    first = next((k for k in range(len(names)) if names[k : k + 4] == ["x", "y", "z", "radius"]), None)
    if first is None:
        raise ValueError("the header has no x,y,z,radius")
    tree, seg = names[:first], names[first:]
    v = F.transform(F.split("value", ","), lambda s: F.trim(s).cast("double"))
    x = lines.withColumn("v", v).withColumn("_n", (F.size("v") - len(tree)) / len(seg))
    x = x.withColumn("_n", F.when(F.col("_n") == F.floor("_n"), F.col("_n").cast("int")).otherwise(F.raise_error(F.lit("a tree's line has another number of fields than its header"))))
    x = x.withColumn("seg_id", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda k: F.get("v", F.col("seg_id") * len(seg) + len(tree) + k)
    rest = [(k, n) for k, n in enumerate(seg) if n not in ("x", "y", "z", "radius", "parent_id")]
    none = F.create_map().cast("map<string,double>")
    attrs = F.create_map(*[y for k, n in rest for y in (F.lit(n), at(k))]) if rest else none
    whole = F.create_map(*[y for k, n in enumerate(tree) for y in (F.lit(n), F.get("v", F.lit(k)))]) if tree else none
    parent = at(seg.index("parent_id")).cast("int") if "parent_id" in seg else F.lit(-1)
    return x.select("tree_id", "seg_id", *[at(k).alias(n) for k, n in enumerate(seg[:4])], parent.alias("parent_id"), attrs.alias("attrs"), whole.alias("tree_attrs"))


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """A tree file: # comments, a header line, a line for each tree. Lines are numbered by their place among all."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda s: (F.trim(s) != "") & ~F.startswith(F.trim(s), F.lit("#")))).alias("tree_id", "value"))
    header = lines.where("tree_id = 0").first()["value"]
    return parse_trees(lines.where("tree_id > 0").withColumn("tree_id", (F.col("tree_id") - 1).cast("long")), header)


def format_trees(segments: DataFrame) -> DataFrame:
    """tree_id, value: a line for each tree under the header x,y,z,radius,parent_id, segments in order."""
    one = F.concat_ws(",", *[F.round(c, 5).cast("string") for c in ("x", "y", "z", "radius")], F.col("parent_id").cast("string"))
    rows = segments.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("seg_id", one.alias("s")))).alias("rows"))
    return rows.select("tree_id", F.array_join(F.transform("rows", lambda r: r["s"]), ", ").alias("value"))


def parse_trunks(lines: DataFrame) -> DataFrame:
    """x, y, z, radius from lines of exactly four fields."""
    p = F.split("value", ",")
    x = lines.where("trim(value) <> '' and not startswith(trim(value), '#') and not startswith(trim(value), 'x')")
    return x.where(F.size(p) == 4).select(*[F.trim(F.get(p, k)).cast("double").alias(n) for k, n in enumerate(("x", "y", "z", "radius"))])


def format_points(rays: DataFrame, kind: str = "txt") -> DataFrame:
    """Lines (value) in order of ray_id: txt has x,y,z,time,red,green,blue,alpha; xyz has x y z."""
    number = lambda c: F.format_string("%.4f", F.col(c))
    if kind == "xyz":
        return rays.select("ray_id", F.concat_ws(" ", *[number(c) for c in ("ex", "ey", "ez")]).alias("value"))
    return rays.select("ray_id", F.concat_ws(",", *[number(c) for c in ("ex", "ey", "ez", "time")], *[F.col(c).cast("string") for c in ("red", "green", "blue", "alpha")]).alias("value"))


def parse_projection(lines: DataFrame) -> DataFrame:
    """key, value of +key=value tokens; bare flags have an empty value, # begins a comment."""
    token = F.explode(F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"\s+")).alias("t")
    x = lines.select(token).where("startswith(t, '+')")
    return x.select(F.regexp_extract("t", r"^\+([^=]*)", 1).alias("key"), F.regexp_extract("t", "=(.*)$", 1).alias("value"))
