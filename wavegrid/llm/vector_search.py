"""Exact top-k search by inner product, pruned block by block.

Vectors are whole numbers.  A vector's two largest components, taken as terms,
name its cluster; rows are ordered by cluster and id, and cut into blocks, each a
document range of one cluster or of neighbouring ones.  A block keeps a forward
index (its matrix, in the smallest type that holds it) and, for every term, the
largest and the smallest value.  For one query the sum over terms of the larger
of ``q * max`` and ``q * min`` bounds every score of the block.  A query scores
its ``FIRST`` blocks of highest bound through their forward index, in that order;
after that, blocks are taken by falling bound, each for all queries whose bound
reaches their k-th score (or equals it while the block holds a smaller id), and
the others skip it.

A shard is a contiguous run of blocks.  A floor per query, its k-th score over
the pilot (at most ``PILOT`` vectors, which bounds what is sent along), lies below
or at its k-th score over all rows.  Query blocks go to every shard that has a
bound at or over a floor; the shards' bounds are sent along while they take at
most ``SUMMARY`` bytes, and beyond that each shard tests its own blocks only.
Each shard returns k rows per query that are then merged.  This is the stated
query set against all rows.

Pruning depends on the data: where vectors have no clusters and many dimensions
of like weight, no bound of a block lies below a k-th score, and all blocks are
scored (see :func:`visits`).

Cases: a vector that is null or holds a null, NaN or infinite component takes no
part, nor does a row with a null id; a vector shorter than others counts as
padded with zeros; an id names its row: rows that share a query's id are never
its candidates, and a query id that occurs in several rows is asked once, with
the smallest of its vectors; repeated candidates keep a place each.  Ties go to
the smaller id.  A query with fewer than k candidates gets them all; an empty
table gives an empty result.  Scaled components beyond ``HUGE`` count as that;
scores are exact, and those beyond a long count as the nearest long.  Other columns are not read, and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.llm.common import materialize, partitions
from wavegrid.runtime import ship

BLOCK_ROWS, QUERY_ROWS, PILOT, FIRST, HUGE = 512, 256, 4096, 4, 1e150

#: Bytes of a shard's vectors, as four each, and of the shards' bounds.
SHARD, SUMMARY = 1 << 28, 1 << 26

_TYPES = (np.int16, np.int32, np.float64)
_LEAST, _MOST = -(2**63), 2**63 - 1


def scaled(vector: Column, factor: float = 256.0) -> Column:
    """floor(factor * x) of each component, x as double, as a whole double."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(factor))
        near = F.greatest(F.lit(-HUGE), F.least(F.lit(HUGE), y))
        return F.when(F.abs(y) < F.lit(2.0**53), F.floor(y).cast("double")).otherwise(near)

    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as float64, padded with zeros."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    values = np.asarray(column.flatten(), dtype=np.float64)
    sizes = np.diff(offsets)
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    return out


def _stored(m: np.ndarray) -> tuple[bytes, int]:
    """A matrix of whole numbers and its type's place in ``_TYPES``."""
    most = np.abs(m).max(initial=0)
    code = 0 if most < 1 << 15 else 1 if most < 1 << 31 else 2
    return m.astype(_TYPES[code]).tobytes(), code


_PACKED = "ids binary, matrix binary, width int, code int"


def _packed(ids: np.ndarray, m: np.ndarray) -> list[pa.Array]:
    body, code = _stored(m)
    return [pa.array([ids.astype(np.int64).tobytes()]), pa.array([body]), pa.array([m.shape[1]], pa.int32()), pa.array([code], pa.int32())]


def _pack(rows: int):
    """Packs the rows of a sorted partition into blocks of at most ``rows``, with
    the largest and the smallest value of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids, parts):
            width = max(p.shape[1] for p in parts)
            m = np.concatenate([_fit(p, width) for p in parts])
            return pa.RecordBatch.from_arrays([*_packed(np.concatenate(ids), m), pa.array([m.max(axis=0).tobytes()]), pa.array([m.min(axis=0).tobytes()])], names=["ids", "matrix", "width", "code", "top", "low"])

        ids: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            own, m = np.asarray(batch.column(0)), _matrix(batch.column(1))
            at = 0
            while at < len(own):
                take = min(rows - held, len(own) - at)
                ids.append(own[at : at + take])
                parts.append(m[at : at + take])
                at, held = at + take, held + take
                if held == rows:
                    yield block(ids, parts)
                    ids, parts, held = [], [], 0
        if held:
            yield block(ids, parts)

    return run


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(row["ids"], np.int64)
    return i, np.frombuffer(row["matrix"], _TYPES[row["code"]]).reshape(len(i), row["width"])


def _fit(m: np.ndarray, width: int) -> np.ndarray:
    return m[:, :width] if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products; whole numbers of any size where a double could
    round, those beyond a long as the nearest long."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)))
    most = max(1.0, float(np.abs(queries).max())) * max(1.0, float(np.abs(rows).max())) * rows.shape[1]
    if most < 2.0**24:
        return (queries.astype(np.float32) @ rows.T.astype(np.float32)).astype(np.float64)
    if most < 2.0**53:
        return queries.astype(np.float64) @ rows.T.astype(np.float64)
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(queries) @ exact(rows).T, _LEAST, _MOST)


def bounds_of(queries: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block, a score that none of the block's exceeds."""
    width = max(queries.shape[1], top.shape[1])
    q, top, low = _fit(queries, width).astype(np.float64), _fit(top, width), _fit(low, width)
    return np.clip(products(np.maximum(q, 0), top) + products(np.minimum(q, 0), low), _LEAST, _MOST)


def _best(scores, ids, k):
    """Positions of the k best by (score down, id up)."""
    if len(scores) > 4 * k and scores.dtype != object:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


_FOUND = "query_id bigint, vec_id bigint, score bigint, visited bigint, blocks bigint"


def _search(k: int):
    """The k best of each shard for each of its queries, and a row without a
    ``vec_id`` with the number of blocks it scored and those that there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[tuple] = []  # of the shard at hand; its queries come after them
        shard = None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if row["shard"] != shard:
                        shard, blocks = row["shard"], []
                    ids, m = _unpack(row)
                    if row["kind"] == 0:
                        blocks.append((ids, m, np.frombuffer(row["top"]), np.frombuffer(row["low"])))
                    elif blocks:
                        yield _ask(ids, m, np.frombuffer(row["floors"]), blocks, k)

    return run


def _ask(ids, m, floors, blocks, k) -> pa.RecordBatch:
    width = max(m.shape[1], max(b[1].shape[1] for b in blocks))
    m = _fit(m, width)
    bounds = bounds_of(m, np.stack([_fit(b[2][None], width)[0] for b in blocks]), np.stack([_fit(b[3][None], width)[0] for b in blocks]))
    first = np.array([b[0].min() for b in blocks])
    best_s = [np.zeros(0, bounds.dtype)] * len(ids)
    best_i = [np.zeros(0, np.int64)] * len(ids)
    reach = np.array(floors, dtype=bounds.dtype)  # of a query's k-th score, or its floor
    last = np.full(len(ids), np.iinfo(np.int64).max)  # id of its k-th row
    seen = np.zeros(bounds.shape, bool)

    def visit(b: int, asking: np.ndarray) -> None:
        open_ = (bounds[asking, b] > reach[asking]) | ((bounds[asking, b] == reach[asking]) & (first[b] < last[asking]))
        asking = asking[open_.astype(bool)]
        if not len(asking):
            return
        seen[asking, b] = True
        own = blocks[b][0]
        scores = products(m[asking], _fit(blocks[b][1], width))
        better = (scores >= reach[asking][:, None]).astype(bool) & (own[None, :] != ids[asking][:, None])
        for x in np.flatnonzero(better.any(axis=1)):
            q, ok = asking[x], better[x]
            s_all, i_all = np.concatenate([best_s[q], scores[x][ok]]), np.concatenate([best_i[q], own[ok]])
            near = _best(s_all, i_all, k)
            best_s[q], best_i[q] = s_all[near], i_all[near]
            if len(near) == k:
                reach[q], last[q] = best_s[q][-1], best_i[q][-1]

    # Each query's best blocks first; queries at the same block share a product.
    order = np.argsort(-bounds.astype(float), axis=1, kind="stable")[:, :FIRST]
    for step in range(order.shape[1]):
        for b in np.unique(order[:, step]):
            visit(b, np.flatnonzero(order[:, step] == b))
    every = np.arange(len(ids))
    done = np.zeros(bounds.shape, bool)
    done[every[:, None], order] = True
    for b in np.argsort(-bounds.astype(float).max(axis=0), kind="stable"):
        visit(b, np.flatnonzero(~done[:, b]))
    n = [len(x) for x in best_s]
    query, vec = np.concatenate([np.repeat(ids, n), ids]), np.concatenate([*best_i, np.zeros(len(ids), np.int64)])
    counts = np.arange(len(query)) >= sum(n)
    score = [int(x) for s in best_s for x in s] + [0] * len(ids)
    visited = np.concatenate([np.zeros(sum(n), np.int64), seen.sum(axis=1)])
    there = np.where(counts, len(blocks), 0)
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec, mask=counts), pa.array(score, pa.int64()), pa.array(visited), pa.array(there)], names=["query_id", "vec_id", "score", "visited", "blocks"])


def _floors(pilot_ids: np.ndarray, pilot: np.ndarray, k: int):
    """Adds to each query block the k-th score over the pilot, or -inf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                ids, m = _unpack(row)
                floors = np.full(len(ids), -np.inf)
                if len(pilot_ids) > k:
                    width = max(m.shape[1], pilot.shape[1])
                    s = products(_fit(m, width), _fit(pilot, width)).astype(float)
                    s[ids[:, None] == pilot_ids[None, :]] = -np.inf
                    floors = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    floors = np.where(np.abs(floors) < 2.0**53, floors, -np.inf)
                found.append(floors.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("ids", "matrix", "width", "code")), pa.array(found, pa.binary())], names=["ids", "matrix", "width", "code", "floors"])

    return run


def _address(shards: int, top: np.ndarray | None, low: np.ndarray | None):
    """Each query block for each shard, with the queries whose floor the shard's
    bound reaches (all, if the bounds are not at hand)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 16) for r in batch.slice(at, 16).to_pylist()):
                ids, m = _unpack(row)
                floors = np.frombuffer(row["floors"])
                near = np.ones((len(ids), shards), bool)
                if top is not None:
                    near = (bounds_of(m, top, low) >= floors[:, None]).astype(bool)
                for shard in np.flatnonzero(near.any(axis=0)):
                    q = near[:, shard]
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *_packed(ids[q], m[q]), pa.array([floors[q].tobytes()])], names=["shard", "ids", "matrix", "width", "code", "floors"])

    return run


def _search_all(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column | None, k: int, factor: float, shards: int | None, block_rows: int) -> DataFrame:
    spark = vectors.sparkSession
    ship(spark)
    is_query = F.col("vec_id") % 50 == 0 if is_query is None else is_query
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.select("vec_id", scaled(F.col("v"), factor).alias("v"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    shards = shards or max(partitions(spark), -(-size["n"] * (size["width"] or 0) * 4 // SHARD))

    falling = F.sort_array("v", False)
    lead = [F.array_position("v", F.get(falling, F.lit(i))) for i in (0, 1)]
    ordered = rows.select("vec_id", "v", lead[0].alias("one"), lead[1].alias("two"))
    docs = ordered.repartitionByRange(shards, "one", "two", "vec_id", F.xxhash64("v")).sortWithinPartitions("one", "two", "vec_id").select("vec_id", "v")
    blocks = materialize(docs.mapInArrow(_pack(block_rows), f"{_PACKED}, top binary, low binary").withColumn("shard", F.spark_partition_id()), "blocks")

    pilot = rows.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id", "v").limit(PILOT).select("vec_id", "v").toArrow()
    pilot_ids = np.asarray(pilot.column(0).combine_chunks(), dtype=np.int64) if pilot.num_rows else np.zeros(0, np.int64)
    pilot_rows = _matrix(pilot.column(1).combine_chunks()) if pilot.num_rows else np.zeros((0, 0))
    top = low = None
    width = size["width"] or 0
    if 0 < shards * width * 16 <= SUMMARY:
        top, low = np.full((shards, width), -np.inf), np.full((shards, width), np.inf)

        def widest(group):
            parts = [(_fit(np.frombuffer(t)[None], width)[0], _fit(np.frombuffer(w)[None], width)[0]) for t, w in zip(group["top"], group["low"])]
            return group.iloc[:1][["shard"]].assign(top=np.max([p[0] for p in parts], axis=0).tobytes(), low=np.min([p[1] for p in parts], axis=0).tobytes())

        for r in blocks.select("shard", "top", "low").groupBy("shard").applyInPandas(widest, "shard int, top binary, low binary").collect():
            top[r["shard"]], low[r["shard"]] = np.frombuffer(r["top"]), np.frombuffer(r["low"])
        empty = np.isinf(top).any(axis=1)
        top[empty], low[empty] = 0, 0

    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.mapInArrow(_pack(QUERY_ROWS), f"{_PACKED}, top binary, low binary").mapInArrow(_floors(pilot_ids, pilot_rows, k), f"{_PACKED}, floors binary")
    asked = asked.mapInArrow(_address(shards, top, low), f"shard int, {_PACKED}, floors binary").withColumn("kind", F.lit(1))
    met = blocks.withColumn("kind", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    return met.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_search(k), _FOUND)


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", is_query: Column | None = None, k: int = 5, factor: float = 256.0, shards: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best other rows.

    ``is_query`` is a condition over ``vec_id``; by default every id divisible
    by 50 asks.
    """
    found = _search_all(vectors, id_col, vector_col, is_query, k, factor, shards, block_rows).where("vec_id is not null").select("query_id", "vec_id", "score")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def visits(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", is_query: Column | None = None, k: int = 5, factor: float = 256.0, shards: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, visited and blocks of each query: the blocks that :func:`top_k`
    scores for it, and those of the shards that it is sent to."""
    found = _search_all(vectors, id_col, vector_col, is_query, k, factor, shards, block_rows).where("vec_id is null")
    return found.groupBy("query_id").agg(F.sum("visited").alias("visited"), F.sum("blocks").alias("blocks"))
