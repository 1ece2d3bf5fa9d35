"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, drop_stored, stored


def forest(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components, for each partition a star around each component's smallest node."""
    import numpy as np
    import pyarrow as pa

    def stars(batches: Batches) -> Batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (p := parent.get(top, top)) != top:
                top = p
            while (p := parent.get(x, x)) != top:
                parent[x], x = top, p
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                parent.setdefault(a, a)
                parent.setdefault(b, b)
        nodes = [x for x in parent if root(x) != x]
        for k in range(0, len(nodes), 65536):
            part = nodes[k : k + 65536]
            yield pa.record_batch([pa.array(np.array([root(x) for x in part], np.int64)), pa.array(np.array(part, np.int64))], ["a", "b"])

    return links.mapInArrow(stars, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) of all nodes of links (a, b: long): the smallest node that can be reached.

    Alternates two steps until nothing changes: each node links its larger neighbours to its smallest one, then its
    smaller neighbours and itself to the smallest. The links never grow in number; each step is two shuffles by node, with
    smallest neighbours aggregated before the shuffle. Links of a node with itself, repeated links and none at all are fine.
    """
    now = stored(links.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a < b").distinct())
    was = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        large = large.where("a < b").distinct()
        # b is the larger node: its smallest neighbour m; all its smaller ones and itself go to m
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m"), F.col("a").alias("x")).unionAll(least.select("m", F.col("b").alias("x")))
        after = stored(small.select(F.col("m").alias("a"), F.col("x").alias("b")).where("a < b").distinct())
        state = after.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        drop_stored(now)
        now = after
        if was == (state["n"], state["h"]):
            tops = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            out = stored(now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(tops))
            drop_stored(now)
            return out
        was = (state["n"], state["h"])
