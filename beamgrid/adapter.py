"""The driver's tables seen as ray clouds: the same integer and double arithmetic in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: event_type: red, green, blue.
TYPE_COLOURS = {"click": (200, 60, 20), "error": (10, 10, 10), "purchase": (30, 180, 90), "signup": (90, 40, 220), "view": (250, 240, 5)}


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ray cloud from events: a row for each event, in order of event_id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, u = F.col("event_id"), F.col("user_id")

    def by_type(k: int):
        c = F.lit(0)
        for name, rgb in TYPE_COLOURS.items():
            c = F.when(F.col("event_type") == name, F.lit(rgb[k])).otherwise(c)
        return c.cast("short")

    d = lambda x: F.lit(float(x))
    return e.select(
        i.alias("ray_id"),
        (d(10.005) + (i % 100) / d(100)).alias("sx"), d(10.25).alias("sy"), d(6.25).alias("sz"),
        ((i * 37 % 997) / d(50)).alias("ex"), ((u * 53 % 701) / d(35)).alias("ey"), (F.col("value") / d(100)).alias("ez"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / d(1e6)).alias("time"),
        by_type(0).alias("red"), by_type(1).alias("green"), by_type(2).alias("blue"),
        F.when(F.col("event_type") == "error", 0).otherwise(1 + i % 255).cast("short").alias("alpha"),
    )


def rays_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second cloud: two of three rays, with their ends moved a little."""
    shift = ((F.col("ray_id") % 7) - 3) / F.lit(100.0)
    return rays(spark, sf_dir).where("ray_id % 3 <> 0").withColumns({c: F.col(c) + shift for c in ("ex", "ey", "ez")})


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor positions, one of twenty rays."""
    return rays(spark, sf_dir).where("ray_id % 20 = 0").select("time", F.col("sx").alias("x"), F.col("sy").alias("y"), (F.col("sz") + F.col("ray_id") / F.lit(1000.0)).alias("z"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees: a chain of segments for each user, upwards in order of events."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    d = lambda x: F.lit(float(x))
    return e.select(
        F.col("user_id").alias("tree_id"), n.cast("int").alias("seg_id"),
        ((F.col("user_id") * 53 % 701) / d(35) + n / d(10)).alias("x"), ((F.col("user_id") * 31 % 601) / d(30)).alias("y"),
        (n / d(4)).alias("z"), (d(0.05) + (F.col("event_id") % 10) / d(50)).alias("radius"), (n - 1).cast("int").alias("parent_id"),
    )


def _case(k: int) -> str:
    return "case " + " ".join(f"when event_type = '{n}' then {c[k]}" for n, c in TYPE_COLOURS.items()) + " else 0 end"


#: Common table expressions for DuckDB, by name.
CTES = {
    "rays": f"""rays as (select event_id ray_id, 10.005::double + (event_id % 100) / 100::double sx, 10.25::double sy, 6.25::double sz,
  (event_id * 37 % 997) / 50::double ex, (user_id * 53 % 701) / 35::double ey, value / 100::double ez, epoch_us(ts) / 1e6::double as time,
  cast({_case(0)} as smallint) red, cast({_case(1)} as smallint) green, cast({_case(2)} as smallint) blue,
  cast(case when event_type = 'error' then 0 else 1 + event_id % 255 end as smallint) alpha from events)""",
    "rays_b": """rays_b as (select ray_id, sx, sy, sz, ex + ((ray_id % 7) - 3) / 100::double ex, ey + ((ray_id % 7) - 3) / 100::double ey,
  ez + ((ray_id % 7) - 3) / 100::double ez, time, red, green, blue, alpha from rays where ray_id % 3 <> 0)""",
    "trajectory": "trajectory as (select time, sx x, sy y, sz + ray_id / 1000::double z from rays where ray_id % 20 = 0)",
    "segments": """segments as (select user_id tree_id, cast(n as int) seg_id, (user_id * 53 % 701) / 35::double + n / 10::double x,
  (user_id * 31 % 601) / 30::double y, n / 4::double z, 0.05::double + (event_id % 10) / 50::double radius, cast(n - 1 as int) parent_id
  from (select *, row_number() over (partition by user_id order by event_id) - 1 n from events))""",
}
NEEDS = {"rays_b": ["rays"], "trajectory": ["rays"]}


def duck(body: str, *tables: str, recursive: bool = False) -> str:
    """A DuckDB query: the named tables' expressions before body, which may begin with more of them ("name as (...), ... select")."""
    names: list[str] = []
    for t in tables or ("rays",):
        names += [x for x in (*NEEDS.get(t, []), t) if x not in names]
    head = "with " + ("recursive " if recursive else "") + ",\n".join(CTES[n] for n in names)
    body = body.strip()
    return f"{head}\n{body}" if body.lower().startswith("select") else f"{head},\n{body}"
