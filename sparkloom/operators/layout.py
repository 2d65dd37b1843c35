"""Placement of rows on nodes and partitions."""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_points(nodes: list[str], copies: int) -> list[tuple[int, str]]:
    return sorted((int(hashlib.md5(f"{n}#{i}".encode()).hexdigest()[:8], 16), n) for n in nodes for i in range(copies))


def ring_node(key: Column, nodes: list[str], copies: int = 64) -> Column:
    """The node of the first point strictly after the key's hash, the first point of all after the last."""
    points = ring_points(nodes, copies)
    h = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")
    ring = F.array(*(F.struct(F.lit(p).cast("long").alias("p"), F.lit(n).alias("n")) for p, n in points))
    after = F.filter(ring, lambda x: x["p"] > h)
    return F.coalesce(F.try_element_at(after, F.lit(1))["n"], F.lit(points[0][1]))


def ring_node_of(key: str, nodes: list[str], copies: int = 64) -> str:
    """The same for one key on the driver."""
    points = ring_points(nodes, copies)
    h = int(hashlib.md5(key.encode()).hexdigest()[:8], 16)
    return points[bisect.bisect_right([p for p, _ in points], h) % len(points)][1]
