import itertools

import pytest
from pyspark.sql import functions as F

from wavegrid.operators import grid


def loop(total, chunk, overlap):
    """The grid as defined: starts added up, the first to reach the end is last."""
    out, start = [], 0.0
    while start + chunk < total:
        out.append((start, start + chunk))
        start += chunk - overlap
    return out + [(start, float(total))]


def table(spark, totals):
    return spark.createDataFrame([(str(i), float(t)) for i, t in enumerate(totals)], "path string, duration_s double")


# Totals, chunks, overlaps and the intervals that they give.
@pytest.mark.parametrize(
    ("total", "chunk", "overlap", "want"),
    [
        (1, 2, 0, [(0, 1)]),
        (2, 2, 0, [(0, 2)]),
        (2, 2, 1, [(0, 2)]),
        (2, 2, 1.9, [(0, 2)]),
        (4, 2, 0, [(0, 2), (2, 4)]),
        (6, 2, 0, [(0, 2), (2, 4), (4, 6)]),
        (6, 2, 1, [(0, 2), (1, 3), (2, 4), (3, 5), (4, 6)]),
        (6, 2, 0.5, [(0, 2), (1.5, 3.5), (3, 5), (4.5, 6)]),
    ],
)
def test_bounded(spark, total, chunk, overlap, want):
    rows = grid.bounded(table(spark, [total]), chunk_s=chunk, overlap_s=overlap).orderBy("chunk_idx").collect()
    assert [(r.start_s, r.end_s) for r in rows] == want


# Numbers and last intervals of a recording of two minutes.
@pytest.mark.parametrize(("overlap", "n", "last"), [(0, 40, (117, 120)), (1, 60, (118, 120)), (2, 118, (117, 120)), (1.5, 79, (117, 120))])
def test_two_minutes(spark, overlap, n, last):
    rows = grid.bounded(table(spark, [120]), overlap_s=overlap).orderBy("chunk_idx").collect()
    assert len(rows) == n and (rows[-1].start_s, rows[-1].end_s) == last


@pytest.mark.parametrize("overlap", [0.0, 0.1, 0.7, 1.5, 2.3, 2.6, 2.9])
def test_starts_equal_repeated_addition(spark, overlap):
    totals = [x / 10 for x in range(1, 140, 3)] + [3.0, 5.0, 129.4]
    rows = grid.bounded(table(spark, totals), overlap_s=overlap).collect()
    got = {k: [(r.start_s, r.end_s) for r in sorted(g, key=lambda r: r.chunk_idx)] for k, g in itertools.groupby(sorted(rows, key=lambda r: r.path), key=lambda r: r.path)}
    assert got == {str(i): loop(t, 3.0, overlap) for i, t in enumerate(totals)}


def test_bad_totals_have_no_interval(spark):
    rows = spark.createDataFrame([("a", 0.0), ("b", -1.0), ("c", None)], "path string, duration_s double")
    assert grid.bounded(rows).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(0, 0), (3, 3), (3, -1)])
def test_bad_shape(spark, chunk, overlap):
    with pytest.raises(ValueError):
        grid.bounded(table(spark, [1]), chunk_s=chunk, overlap_s=overlap)


@pytest.mark.parametrize(("overlap", "second"), [(0, 2.0), (1, 1.0), (1.9, 0.1), (0.5, 1.5)])
def test_unbounded(spark, overlap, second):
    rows = grid.unbounded(table(spark, [1]), n=2, chunk_s=2, overlap_s=overlap).orderBy("chunk_idx").collect()
    assert rows[0].start_s == 0 and rows[0].end_s == 2
    assert rows[1].start_s == pytest.approx(second) and rows[1].end_s == rows[1].start_s + 2


def test_half_even_frames(spark):
    rows = grid.frames(spark.createDataFrame([(0.5, 1.5)], "start_s double, end_s double"), 5).collect()
    assert (rows[0].start_frame, rows[0].end_frame) == (2, 8)


def older(n, chunk, step, least):
    last = round((n - chunk + step - 1) / step) * step
    if last < 0:
        last = 0
    elif n - last < least:
        last -= step
    return list(range(0, 1 + last, step))


def test_legacy_positions(spark):
    sizes = [1, 50, 100, 150, 199, 200, 299, 300, 350, 450, 500, 700, 799, 1001]
    rows = spark.createDataFrame([(str(n), n) for n in sizes], "path string, n_samples bigint")
    found = grid.legacy(rows, rate=100, chunk_s=3.0, overlap_s=1.0, least_s=2.0).collect()
    for n in sizes:
        assert sorted(r.position for r in found if r.path == str(n)) == older(n, 300, 200, 200), n


def test_batches(spark):
    rows = spark.range(10).select(F.lit("a").alias("path"), F.col("id").alias("chunk_idx"))
    got = [r.members for r in grid.batches(rows, 4).orderBy("batch").collect()]
    assert got == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    with pytest.raises(ValueError):
        grid.batches(rows, 0)
