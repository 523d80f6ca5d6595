"""Quality classifier: kernel ridge regression by random Fourier features.

1. Every text becomes a short vector of document statistics (``STATISTICS``).
2. ``cos(W x + b)`` with a Gaussian ``W`` approximates a Gaussian kernel over
   the standardised statistics.
3. Each partition sums its share of the normal equations, the shares are added
   up by key, and the driver solves one system of fixed size.
4. An isotonic fit on labelled rows that were kept out of step 3 turns the
   ridge score into the probability of label 1.

Statistics, projections and features are rounded to fixed point before they are
summed, so the sums are exact and the fit doesn't depend on how rows are dealt
over partitions.

Labels are learned from a sample of at most ``max_fit_rows`` labelled rows (the
smallest hashes of the id), which bounds what is broadcast and collected.

Cases: null and empty texts have all statistics 0 and get a score like any
other; a row whose id is null or repeated gets its own score; labels that are
null take no part and several labels of one id count as their mean; without any
usable label each score is 0.5, with labels of one kind only it is that label;
equal statistics get equal scores; an empty table of documents gives an empty one.
Other columns, of documents or labels, are not read and can have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavegrid.llm.common import SPACE, id_and_text, portions, utf8
from wavegrid.runtime import ship

STATISTICS = ("log_bytes", "upper", "digit", "stop_mark", "other_mark", "bar", "shout", "non_ascii", "line_rate", "word_bytes", "word_variety", "line_variety", "top_word", "marked_words")

#: Bytes of text described at once.
PORTION = 1 << 20

#: Fixed-point scales of the statistics and of the Fourier features.
UNIT, FEATURE_UNIT = 1 << 14, 1 << 12

#: Tasks that sum the normal equations.
FIT_TASKS = 8

#: Projections take factors of so many places, so that their sums are exact in
#: whatever order they are added.
PLACES = 1 << 12

_byte = np.arange(256)
_UPPER = (_byte >= 65) & (_byte <= 90)
_LOWER = (_byte >= 97) & (_byte <= 122)
_DIGIT = (_byte >= 48) & (_byte <= 57)
_HIGH = _byte >= 128
_STOP = np.isin(_byte, [ord(c) for c in ".,;:?'\"-()"])
_BAR, _SHOUT, _LINE = _byte == ord("|"), _byte == ord("!"), _byte == 10
_OTHER = (_byte > 32) & (_byte < 127) & ~(_UPPER | _LOWER | _DIGIT | _STOP | _BAR | _SHOUT)
_KINDS = np.stack([_UPPER, _DIGIT, _STOP, _OTHER, _BAR, _SHOUT, _HIGH, _LINE, _UPPER | _LOWER | _HIGH])
#: One bit for each kind of byte.
_MASK = (1 << np.arange(len(_KINDS))) @ _KINDS
_MASK = _MASK.astype(np.uint16)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` for each text ``data[offsets[i]:offsets[i + 1]]``,
    as whole multiples of 1 / ``UNIT``."""
    parts = [_statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in portions(offsets, PORTION)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    out = np.zeros((rows, len(STATISTICS)))
    if not len(data):
        return out
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    mask, begins = _MASK[data], offsets[:-1][full]
    kinds = np.stack([np.add.reduceat((mask >> k) & 1, begins, dtype=np.int64) for k in range(len(_KINDS))], axis=1)
    n = sizes[full].astype(float)
    letters = np.maximum(kinds[:, 8], 1)
    out[full, 0] = np.log1p(n)
    out[full, 1] = kinds[:, 0] / letters
    out[full, 2:8] = kinds[:, [1, 2, 3, 4, 5, 6]] / n[:, None]
    out[full, 8] = kinds[:, 7] / n
    whole = data.tobytes()
    for i in full:
        text = whole[offsets[i] : offsets[i + 1]]
        words = text.split()
        if not words:
            continue
        seen = Counter(words)
        lines = text.split(b"\n")
        out[i, 9] = np.log1p((len(text) - len(words) + 1) / len(words))
        out[i, 10] = len(seen) / len(words)
        out[i, 11] = len(set(lines)) / len(lines)
        out[i, 12] = max(seen.values()) / len(words)
    spaces = SPACE[data]
    behind = np.append(spaces[1:], True)
    behind[offsets[1:][full] - 1] = True  # a text's last word ends with it
    ends = np.flatnonzero(~spaces & behind)
    marked = np.zeros(len(data) + 1, np.int64)
    marked[ends + 1] = (mask[ends] & 0b1110000 | mask[ends] & 0b1000) != 0
    held = np.zeros(len(data) + 1, np.int64)
    held[ends + 1] = 1
    marked, held = np.cumsum(marked), np.cumsum(held)
    stops = offsets[1:][full]
    out[full, 13] = (marked[stops] - marked[begins]) / np.maximum(held[stops] - held[begins], 1)
    return np.rint(out * UNIT)


@dataclass(frozen=True)
class Model:
    """A fitted classifier; ``weights`` is None where labels say nothing."""

    centre: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Fourier features, as whole multiples of 1 / ``FEATURE_UNIT``, and a
        constant."""
        z = np.rint(np.clip((x - self.centre) / self.scale, -6, 6) * PLACES) / PLACES
        z = np.rint(np.cos(z @ self.w + self.b) * FEATURE_UNIT)
        return np.column_stack([z, np.full(len(x), float(FEATURE_UNIT))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (self.features(x) / FEATURE_UNIT) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.levels[0])
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the non-decreasing step fit by pooling adjacent
    violators; a level stands at the first and the last score of its pool, and
    scores between two pools are interpolated."""
    at, inverse, counts = np.unique(scores, return_inverse=True, return_counts=True)
    means = np.bincount(inverse, weights=labels) / counts
    pools: list[list[float]] = []  # level, weight, first, last
    for x, y, n in zip(at, means, counts):
        pools.append([y, float(n), x, x])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            level, weight, _, last = pools.pop()
            p = pools[-1]
            p[0] = (p[0] * p[1] + level * weight) / (p[1] + weight)
            p[1] += weight
            p[3] = last
    knots, levels = [], []
    for level, _, first, last in pools:
        knots += [first] if first == last else [first, last]
        levels += [level] if first == last else [level, level]
    return np.array(knots), np.array(levels)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(*utf8(batch.column(2))).astype(np.int64)
        flat = pa.array(x.ravel())
        at = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(at, flat)], names=["target", "held", "x"])


def _equations(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = model.w.shape[1] + 1
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten(), dtype=float).reshape(batch.num_rows, -1)
                y = np.rint(np.asarray(batch.column(0), dtype=float) * FEATURE_UNIT)
                z = model.features(x)
                total += z.T @ np.column_stack([z, y])
        if total.any():
            i, j = np.indices(total.shape)
            keep = i <= j
            yield pa.RecordBatch.from_arrays([pa.array(i[keep].astype(np.int32)), pa.array(j[keep].astype(np.int32)), pa.array(total[keep].astype(np.int64))], names=["i", "j", "v"])

    return run


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str, eligible: Column | None, max_rows: int) -> DataFrame:
    """(target, held, x) of the sample that is learned from.

    ``eligible`` is a condition on the id (column ``doc_id``).  The sample is
    of ``max_rows`` rows of two numbers, which bounds its broadcast.
    """
    known = labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).cast("double").alias("target")).where("doc_id is not null and target is not null")
    if eligible is not None:
        known = known.where(eligible)
    known = known.groupBy("doc_id").agg(F.avg("target").alias("target"))
    known = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_rows)
    known = known.select("doc_id", "target", (F.pmod("h", F.lit(4)) == 0).alias("held"))
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(known), "doc_id").select("target", "held", "text")
    return rows.mapInArrow(_describe, "target double, held boolean, x array<bigint>")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", eligible: Column | None = None, max_fit_rows: int = 24_000, n_features: int = 256, width: float = 4.0, ridge: float = 1e-4, seed: int = 7) -> Model:
    """Learns a :class:`Model`; the driver gets at most ``max_fit_rows`` pairs of
    score and label and a matrix of ``n_features`` squared."""
    ship(docs.sparkSession)
    size = len(STATISTICS)
    sample = _labelled(docs, labels, id_col, text_col, label_id, label_col, eligible, max_fit_rows).persist()
    try:
        sums = sample.agg(F.count("*").alias("n"), F.min("target").alias("low"), F.max("target").alias("high"), *(F.sum(F.col("x")[k]).alias(f"s{k}") for k in range(size)), *(F.sum(F.col("x")[k].cast("decimal(38,0)") * F.col("x")[k]).alias(f"q{k}") for k in range(size))).first()
        n = sums["n"]
        rng = np.random.default_rng(seed)
        w = np.rint(rng.standard_normal((size, n_features)) / width * PLACES) / PLACES
        b = rng.uniform(0, 2 * np.pi, n_features)
        if not n or sums["low"] == sums["high"]:
            level = 0.5 if not n else float(sums["low"])
            return Model(np.zeros(size), np.ones(size), w, b, None, np.zeros(1), np.array([min(max(level, 0.0), 1.0)]))
        centre = np.array([sums[f"s{k}"] / n for k in range(size)])
        spread = np.array([float(sums[f"q{k}"]) / n for k in range(size)]) - centre**2
        model = Model(centre, np.sqrt(np.maximum(spread, 0)) + 0.01 * UNIT, w, b, np.zeros(0), np.zeros(0), np.zeros(0))
        # The sample is bounded, so some tasks are enough for any size of the table.
        shares = sample.where("not held").select("target", "x").repartition(FIT_TASKS).mapInArrow(_equations(model), "i int, j int, v bigint")
        total = shares.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
        m = n_features + 1
        a = np.zeros((m, m + 1))
        a[total["i"], total["j"]] = total["v"]
        a /= FEATURE_UNIT**2
        gram = np.triu(a[:, :m]) + np.triu(a[:, :m], 1).T
        weights = np.linalg.solve(gram + ridge * max(1.0, gram[-1, -1]) * np.eye(m), a[:, m])
        model = Model(centre, model.scale, w, b, weights, np.zeros(0), np.zeros(0))
        held = sample.where("held").select("target", "x").toPandas()
        if held.empty:
            knots, levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        else:
            knots, levels = isotonic(np.round(model.raw(np.stack(held["x"].to_numpy()).astype(float)), 9), held["target"].to_numpy())
        return Model(centre, model.scale, w, b, weights, knots, levels)
    finally:
        sample.unpersist()


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(statistics(*utf8(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from ``threshold`` on) per row,
    in one pass over the texts without a shuffle."""
    ship(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_scores(model), schema).withColumn("predicted", (F.col("score") >= F.lit(threshold)).cast("int"))


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their
    columns; the verdict is taken beside the row, so nothing is joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = model.score(statistics(*utf8(batch.column(batch.schema.get_field_index(text_col))))) >= threshold
            yield batch.filter(pa.array(good))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
