import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavegrid.llm import quality
from wavegrid.llm.common import bucket_of
from wavegrid.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op3_quality"](spark, DATA).toPandas()
    docs, labels = pd.read_parquet(f"{DATA}/documents.parquet"), pd.read_parquet(f"{DATA}/labels.parquet")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.quality == held.predicted).mean() > 0.95


def test_fit_does_not_depend_on_partitions(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    eligible = bucket_of(F.col("doc_id"), 5) != 0
    a = quality.fit(docs, labels, eligible=eligible)
    b = quality.fit(docs.repartition(7, "source"), labels.repartition(3), eligible=eligible)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.levels, b.levels)


def test_scores_equal_a_dense_solution(spark):
    """Statistics, features, normal equations, ridge and calibration once more, on
    one machine."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels, eligible=bucket_of(F.col("doc_id"), 5) != 0)
    frame, known = docs.toPandas(), labels.toPandas().dropna(subset=["quality"]).groupby("doc_id").quality.mean()
    texts = [(t or "").encode() for t in frame.text]
    x = quality.statistics(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    ids = frame.doc_id.to_numpy()
    learned = np.array([i in known.index and zlib.crc32(str(i).encode()) % 5 != 0 for i in ids])
    hashed = {r.doc_id: r.h for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("h")).collect()}
    held = np.array([hashed[i] == 0 for i in ids])
    y = np.array([known.get(i, 0.0) for i in ids])
    centre, scale = x[learned].mean(axis=0), np.sqrt(x[learned].var(axis=0)) + 0.01 * quality.UNIT
    assert model.centre == pytest.approx(centre) and model.scale == pytest.approx(scale, rel=1e-6)
    rng = np.random.default_rng(7)
    w, b = np.rint(rng.standard_normal((x.shape[1], 256)) / 4.0 * quality.PLACES) / quality.PLACES, rng.uniform(0, 2 * np.pi, 256)
    z = np.rint(np.clip((x - centre) / scale, -6, 6) * quality.PLACES) / quality.PLACES
    z = np.column_stack([np.rint(np.cos(z @ w + b) * quality.FEATURE_UNIT) / quality.FEATURE_UNIT, np.ones(len(x))])
    fit = learned & ~held
    gram = z[fit].T @ z[fit]
    weights = np.linalg.solve(gram + 1e-4 * gram[-1, -1] * np.eye(257), z[fit].T @ y[fit])
    raw = np.round(z @ weights, 9)
    knots, levels = quality.isotonic(raw[learned & held], y[learned & held])
    want = dict(zip(ids, np.clip(np.interp(z @ weights, knots, levels), 0, 1)))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert np.abs(model.weights - weights).max() < 1e-3 * max(1, np.abs(weights).max())
    assert np.mean([abs(got[i] - want[i]) < 1e-3 for i in got]) > 0.98


def test_clashing_columns_of_labels(docs, spark):
    rows = [(i, f"plain words number {i} here") for i in range(60)] + [(i, "### $$$ " * 9) for i in range(60, 120)]
    plain = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id bigint, quality int")
    more = plain.selectExpr("doc_id", "quality", "'x' as text", "'y' as target", "1 as held", "2 as h", "'z' as x", "3 as n")
    a, b = quality.fit(docs(rows), plain), quality.fit(docs(rows), more)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.levels, b.levels)


def test_isotonic():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 30, 200).astype(float)
    y = (rng.random(200) < x / 40).astype(float)
    knots, levels = quality.isotonic(x, y)
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) > 0).all()
    fit = np.interp(x, knots, levels)

    def brute(v):  # max over starts of min over ends of the mean label
        return max(min(y[(x >= a) & (x <= b)].mean() for b in np.unique(x[x >= v])) for a in np.unique(x[x <= v]))

    assert fit == pytest.approx([brute(v) for v in x])


def test_statistics_do_not_depend_on_neighbours():
    texts = [b"", b"One two.\nOne two.", "ÉÀ !!! ###".encode(), b"  ", b"x" * 100]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    rows = quality.statistics(data, offsets)
    for t, row in zip(texts, rows):
        alone = quality.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.array_equal(alone[0], row)
    named = dict(zip(quality.STATISTICS, rows[1] / quality.UNIT))
    assert named["line_variety"] == 0.5 and named["word_variety"] == 0.5 and named["top_word"] == 0.5


def test_odd_rows(docs, odd_rows, spark):
    some = [(i, f"plain words number {i} here") for i in range(100, 140)] + [(i, "### $$$ " * 9) for i in range(140, 180)]
    rows = [(i, int(i < 140)) for i in range(100, 180)] + [(None, 1), (100, None), (101, 0), (101, 1)]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int")
    model = quality.fit(docs(some), labels)
    got = quality.score(docs(odd_rows + some), model).collect()
    assert len(got) == len(odd_rows) + len(some) and all(0 <= r.score <= 1 for r in got)
    verdict = {r.doc_id: r.predicted for r in got}
    assert all(verdict[i] == int(i < 140) for i in range(102, 180))
    kept = quality.keep_good(docs(odd_rows + some), model)
    assert kept.columns == docs([]).columns and {150}.isdisjoint({r.doc_id for r in kept.collect()})
    assert quality.score(docs([]), model).collect() == []


def test_no_labels_or_one_kind(docs, spark):
    for rows, want in (([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (2, 0)], 0.0)):
        model = quality.fit(docs([(1, "a"), (2, "b")]), spark.createDataFrame(rows, "doc_id bigint, quality int"))
        assert [r.score for r in quality.score(docs([(3, "c")]), model).collect()] == [want]
