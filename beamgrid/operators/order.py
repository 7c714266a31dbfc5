"""File order without a global sort: rows are numbered and compared within blocks of ray_id, and blocks meet by their edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamgrid.functions import geometry as g

BLOCK = 1 << 16


def numbered(df: DataFrame, key: str = "ray_id", name: str = "index", block: int = BLOCK) -> DataFrame:
    """With a column index: the row's place in order of key, from 0. One small row a block goes to every task."""
    x = df.withColumn("_block", F.floor(F.col(key) / block))
    counts = x.groupBy("_block").count()
    before = counts.select("_block", (F.sum("count").over(Window.orderBy("_block")) - F.col("count")).alias("_before"))
    x = x.withColumn("_nth", F.row_number().over(Window.partitionBy("_block").orderBy(key)) - 1)
    return x.join(F.broadcast(before), "_block").withColumn(name, (F.col("_before") + F.col("_nth")).cast("long")).drop("_block", "_before", "_nth")


def with_previous(df: DataFrame, columns: list[str], key: str = "ray_id", block: int = BLOCK) -> DataFrame:
    """With last_<c> for each column: its value in the row before, in order of key; null in the first row."""
    x = df.withColumn("_block", F.floor(F.col(key) / block))
    w = Window.partitionBy("_block").orderBy(key)
    x = x.withColumns({"_prev": F.lag(F.struct(*columns)).over(w)})
    edges = x.groupBy("_block").agg(F.max_by(F.struct(*columns), key).alias("_last"))
    edges = edges.select("_block", F.lag("_last").over(Window.orderBy("_block")).alias("_edge"))
    x = x.join(F.broadcast(edges), "_block").withColumn("_prev", F.coalesce("_prev", "_edge"))
    return x.withColumns({f"last_{c}": F.col(f"_prev.{c}") for c in columns}).drop("_block", "_prev", "_edge")


def adjacent_change(rays: DataFrame) -> DataFrame:
    """ray_id, and the change in range and in time since the ray before."""
    x = with_previous(rays.withColumn("range", g.ray_length()), ["range", "time"])
    return x.select("ray_id", (F.col("range") - F.col("last_range")).alias("range_change"), (F.col("time") - F.col("last_time")).alias("time_change"))


def upper_median(values: DataFrame, key: list[Column] | list[str], value: str) -> DataFrame:
    return values.groupBy(*key).agg(F.median(value).alias("median"))
