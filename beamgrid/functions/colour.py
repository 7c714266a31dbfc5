"""Colour scales, and colours as integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stops of the cyclic spectrum and of the gradient, as red, green, blue.
SPECTRUM = [(1.0, 0.5, 0.0), (0.5, 1.0, 0.0), (0.0, 1.0, 0.5), (0.0, 0.5, 1.0), (0.5, 0.0, 1.0), (1.0, 0.0, 0.1)]
GRADIENT = [(1.0, 0.0, 0.5), (1.0, 0.5, 0.0), (0.5, 1.0, 0.0), (0.0, 1.0, 0.5), (0.0, 0.5, 1.0), (0.5, 0.0, 1.0)]


def _between(v: Column, stops: list[tuple[float, float, float]]) -> list[Column]:
    """Linear between stops, cyclic: v counts stops from 0."""
    at = F.floor(v)
    blend = v - at
    out = []
    for k in range(3):
        channel = F.array(*[F.lit(s[k]) for s in stops])
        one = F.element_at(channel, (at % len(stops) + 1).cast("int"))
        other = F.element_at(channel, ((at + 1) % len(stops) + 1).cast("int"))
        out.append(one * (F.lit(1.0) - blend) + other * blend)
    return out


def spectrum(value: Column) -> list[Column]:
    """Red, green, blue (0 to 1) of a value, repeating at every whole number."""
    return _between(F.lit(6.0) * (value - F.floor(value)), SPECTRUM)


def gradient(value: Column) -> list[Column]:
    """Red, green, blue (0 to 1) of a value between 0 and 1, clamped."""
    return _between(F.lit(0.5) + F.lit(4.0) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), GRADIENT)


def byte(x: Column) -> Column:
    """255 times x, truncated."""
    return (F.lit(255.0) * x).cast("long").cast("short")


def id_to_colour(x: Column) -> list[Column]:
    """A colour for each integer from 0: bits of x + 1 dealt to the channels, most significant first."""
    y = x + 1
    return [sum((F.shiftright(y, i).bitwiseAND(1) * (1 << (7 - i // 3)) for i in range(k, 24, 3)), F.lit(0)).cast("short") for k in range(3)]


def colour_to_id(red: Column, green: Column, blue: Column) -> Column:
    """The inverse; black is -1."""
    channels = [c.cast("long") for c in (red, green, blue)]
    return sum((F.shiftright(channels[i % 3], 7 - i // 3).bitwiseAND(F.lit(1).cast("long")) * (1 << i) for i in range(24)), F.lit(0).cast("long")) - 1
