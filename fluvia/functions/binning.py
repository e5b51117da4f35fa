"""Bins, grid ids and half-open or right-closed classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def left_closed(value: Column, edges: list[float], labels: list[str], other: str | None = None) -> Column:
    """labels[i] for edges[i] <= value < edges[i + 1]."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high, label in zip(edges, edges[1:], labels):
        out = out.when((value >= low) & (value < high), label)
    return out.otherwise(F.lit(other).cast("string"))


def right_closed(value: Column, edges: list[float], labels: list[str], other: str | None = None) -> Column:
    """labels[i] for edges[i] < value <= edges[i + 1]."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high, label in zip(edges, edges[1:], labels):
        out = out.when((value > low) & (value <= high), label)
    return out.otherwise(F.lit(other).cast("string"))


def block_id(x: Column, y: Column, size: float) -> Column:
    return F.concat_ws("_", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))


def cell_index(value: Column, origin: float, size: float) -> Column:
    """The nearest cell; halves go to the even one."""
    return F.rint((value - origin) / size).cast("long")
