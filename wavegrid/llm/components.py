"""Connected components of a graph that no single machine holds.

Union-find inside each partition shrinks the links to stars; alternating large
and small stars then lower every node's label to the least node of its
component.  Hubs are never collected: a label is a minimum that is summed up
before the shuffle and stored, so that the join with it stands alone in its stage,
where adaptive execution can split a hub.  Each round is written to the shared
folder.

Cases: links may be repeated, in either direction, and may join a node with
itself (such a link is dropped); nodes are not null; without links there is no
row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.common import drop_tables, materialize, tables_made

#: Nodes that one union-find holds before its stars are passed on.
HELD = 1 << 18


class UnionFind:
    """Disjoint sets whose root is the least member."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        low, high = (a, b) if a < b else (b, a)
        self.parent[low] = low
        self.parent[high] = low

    def stars(self) -> list[tuple]:
        return [(x, r) for x in self.parent if (r := self.find(x)) != x]


def _shrink(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(sets):
            stars = sets.stars()
            return pa.RecordBatch.from_arrays([pa.array([s[0] for s in stars], kind), pa.array([s[1] for s in stars], kind)], names=["a", "b"])

        sets = UnionFind()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sets.union(a, b)
            if len(sets.parent) > HELD:
                yield out(sets)
                sets = UnionFind()
        yield out(sets)

    return run


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of ``links``; the label is the least node of
    its component.  Nodes are longs or binaries, and links join different
    nodes."""
    kind = pa.binary() if links.schema[a].dataType.typeName() == "binary" else pa.int64()
    name = links.schema[a].dataType.simpleString()
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    stars = materialize(pairs.mapInArrow(_shrink(kind), f"a {name}, b {name}").distinct(), "stars")
    spark, before = links.sparkSession, None
    while True:
        began = tables_made()
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large-stars")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "small-stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_tables(spark, began - 1, tables_made() - 1)  # what this round was made of
        if now == before:
            break
        before = now
    labels = stars.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return labels.unionByName(roots)
