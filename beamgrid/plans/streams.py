"""STR: the streaming forms, drained over the finished table."""

from __future__ import annotations

from pyspark.sql import functions as F

from beamgrid import adapter
from beamgrid.adapter import duck
from beamgrid.registry import register
from beamgrid.streaming import clouds

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


class _Streamed:
    """Stands for a session whose readers are streams, so that the adapter serves both."""

    def __init__(self, spark) -> None:
        self.spark = spark

    @property
    def read(self):
        return self

    def parquet(self, path: str):
        stream = self.spark.readStream.schema(_EVENTS)
        if self.spark.read.parquet(path).inputFiles()[0].endswith(f"/{path.rsplit('/', 1)[-1]}"):  # a stream reads folders
            folder, _, name = path.rpartition("/")
            return stream.option("pathGlobFilter", name).parquet(folder)
        return stream.parquet(path)


def _rays(s, d):
    x = adapter.rays(_Streamed(s), d)
    return x.withColumn("event_time", F.timestamp_seconds(F.floor("time")))


def _voxels(s, d):
    return clouds.drained(clouds.first_per_voxel(_rays(s, d), 2.0)).select("vx", "vy", "vz")


def _slots(s, d):
    x = clouds.drained(clouds.slot_counts(_rays(s, d), "6 hours", "1 hour"), "complete")
    return x.select(F.unix_seconds("slot_start").alias("slot_start"), "rays", "bounded")


register("str01_first_per_voxel", _voxels, duck("select distinct cast(floor(ex / 2.0::double) as bigint) vx, cast(floor(ey / 2.0::double) as bigint) vy, cast(floor(ez / 2.0::double) as bigint) vz from rays"))
register("str02_slot_counts", _slots, duck("select cast(floor(floor(time) / 21600) * 21600 as bigint) slot_start, count(*) rays, count(*) filter (alpha > 0) bounded from rays group by 1"))
