"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of its neighbourhood."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least)


def _state(edges: DataFrame) -> tuple:
    """Equal for equal edge sets; three numbers for the driver."""
    mixed = F.xxhash64("u", "v")
    found = edges.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.sum(F.shiftright(mixed, 20))).first()
    return tuple(found)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) of every node of the edges ``u``, ``v``.

    Each round writes the edges to the shared scratch folder, so a lost executor costs no
    earlier round, and the plan stays short. Rounds grow with the logarithm of the
    longest chain. Loops, repeated and reversed edges change nothing; no edges give no
    rows. Nothing is collected but a count and two sums per round.
    """
    edges = stage(edges.filter("u != v").distinct(), "edges")
    before = None
    while True:
        edges = stage(_small_star(_large_star(edges).distinct()).distinct(), "stars")
        state = _state(edges)
        if state == before:
            break
        before = state
    # Every edge now leads from a node to its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
