"""Shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamgrid import adapter
from beamgrid.functions import geometry as g
from beamgrid.registry import register

POINTS = ("sx", "sy", "sz", "ex", "ey", "ez")
COLOURS = ("red", "green", "blue", "alpha")


def out(df: DataFrame, exact: Iterable[str] = (), rounded: Iterable[str] = (), digits: int = 6) -> DataFrame:
    """Only the named columns: colours as smallint, doubles rounded."""
    return df.select(*[F.col(c) for c in exact], *[g.rounded(c, digits).alias(c) for c in rounded])


def sql_out(exact: Iterable[str] = (), rounded: Iterable[str] = (), digits: int = 6) -> str:
    return ", ".join([*exact, *[f"round({c}, {digits}) + 0.0::double {c}" for c in rounded]])


def on_rays(name: str, op: Callable[[DataFrame], DataFrame], body: str | None, table: str = "rays", recursive: bool = False) -> None:
    """A query that is one operator on one adapted table."""
    source = {"rays": adapter.rays, "rays_b": adapter.rays_b, "trajectory": adapter.trajectory, "segments": adapter.segments}[table]
    register(name, lambda spark, d: op(source(spark, d)), adapter.duck(body, table, recursive=recursive) if body else None)
