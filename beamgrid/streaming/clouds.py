"""Streams of rays: the first of each voxel, and counts over slots of time with late rays."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamgrid.functions import geometry as g


def first_per_voxel(rays: DataFrame, width: float, late: str | None = None) -> DataFrame:
    """The first ray to arrive in each voxel, with vx, vy, vz. With `late` (and an `event_time`), voxels are forgotten that long after."""
    x = rays.withColumns(g.voxel(width))
    if late:
        return x.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["vx", "vy", "vz"])
    return x.dropDuplicates(["vx", "vy", "vz"])


def slot_counts(rays: DataFrame, slot: str, late: str, slide: str | None = None) -> DataFrame:
    """slot_start, rays, bounded: tumbling, or sliding, windows over event_time; a slot is final once the watermark has passed."""
    w = F.window("event_time", slot, slide) if slide else F.window("event_time", slot)
    n = rays.withWatermark("event_time", late).groupBy(w).agg(F.count("*").alias("rays"), F.count_if(F.col("alpha") > 0).alias("bounded"))
    return n.select(F.col("window.start").alias("slot_start"), "rays", "bounded")


def scans(rays: DataFrame, gap: str, late: str) -> DataFrame:
    """scan_start, scan_end, rays: sessions of rays that follow each other within gap."""
    n = rays.withWatermark("event_time", late).groupBy(F.session_window("event_time", gap)).agg(F.count("*").alias("rays"))
    return n.select(F.col("session_window.start").alias("scan_start"), F.col("session_window.end").alias("scan_end"), "rays")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream over finished files gives, as a table in memory; for tests and small files."""
    spark: SparkSession = stream.sparkSession
    name = f"drained_{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
