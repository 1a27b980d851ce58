"""Connected components of a link table, by alternating large-star and small-star steps.

Links are rows (src, dst) of 64-bit numbers. Each round is a minimum by node, which combines
before the shuffle, and a join back; nothing is gathered into lists, so a node with very many
links costs no more memory than any other. The rounds grow with the logarithm of the longest
chain, and lineage is cut after each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut_lineage

MOST_ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst")), F.sum(F.xxhash64("src", "dst").bitwiseAND(0xFFFFFFFF))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link to another; root is the smallest node reachable."""
    links = links.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    links = cut_lineage(links)
    before = None
    for _ in range(MOST_ROUNDS):
        now = _state(links)
        if now == before:
            break
        before = now
        if not now[0]:
            break
        links = cut_lineage(_small_star(_large_star(links)))
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(links.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or the node itself)."""
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
    larger = both.where(F.col("dst") > F.col("src"))
    return larger.join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    links = links.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = links.groupBy("src").agg(F.min("dst").alias("low"))
    moved = links.join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    own = least.select("src", F.col("low").alias("dst"))
    return moved.unionByName(own).where("src <> dst").distinct()
