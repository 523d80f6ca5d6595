import math

import pytest
from pyspark.sql import functions as F

from wavegrid.functions import scalar
from wavegrid.operators import compare, post

NAMES = ["species1", "species2", "species3", "species0"]


def scored(spark, *vectors):
    return spark.createDataFrame([("a", i, 3.0 * i, 3.0 * i + 3, v) for i, v in enumerate(vectors)], "path string, chunk_idx bigint, start_s double, end_s double, logits array<float>")


def listed(rows):
    return [[(p.species, pytest.approx(p.confidence, abs=1e-5)) for p in r.predictions] for r in rows.orderBy("chunk_idx").collect()]


def test_ties_go_by_name(spark):
    rows = post.predictions(scored(spark, [0.1, 0.3, 0.2, 0.1]), NAMES, apply_sigmoid=False, min_confidence=0)
    assert listed(rows) == [[("species2", 0.3), ("species3", 0.2), ("species0", 0.1), ("species1", 0.1)]]


def test_allow_list(spark):
    rows = post.predictions(scored(spark, [0.1, 0.3, 0.2, 0.1]), NAMES, apply_sigmoid=False, min_confidence=0, wanted={"species1", "species2"})
    assert listed(rows) == [[("species2", 0.3), ("species1", 0.1)]]


@pytest.mark.parametrize(("s", "want"), [(0.5, [0.53742985, 0.52497919, 0.51249740, 0.51249740]), (1.5, [0.61063923, 0.57444252, 0.53742985, 0.53742985])])
def test_sigmoid(spark, s, want):
    rows = post.predictions(scored(spark, [0.1, 0.3, 0.2, 0.1]), NAMES, sensitivity=s, min_confidence=0)
    assert [c for _, c in listed(rows)[0]] == [pytest.approx(x, abs=1e-5) for x in want]


def test_zero_is_no_filter_and_nan_never_passes(spark):
    vectors = scored(spark, [-1.0, float("nan"), 0.5, 0.0])
    assert len(listed(post.predictions(vectors, NAMES, apply_sigmoid=False, min_confidence=0))[0]) == 4
    assert listed(post.predictions(vectors, NAMES, apply_sigmoid=False, min_confidence=0.1)) == [[("species3", 0.5)]]


def test_an_empty_interval_keeps_its_row(spark):
    rows = post.predictions(scored(spark, [0.0] * 4, [0.9] * 4), NAMES, apply_sigmoid=False, min_confidence=0.5)
    long = post.long_form(rows).collect()
    assert [(r.chunk_idx, r.rank) for r in long if r.species is None] == [(0, None)]
    assert len(long) == 5


def test_shorter_side_ends_the_list(spark):
    assert listed(post.predictions(scored(spark, [0.5]), NAMES, apply_sigmoid=False)) == [[("species1", 0.5)]]


def test_location_order_keeps_label_order(spark):
    row = scored(spark, [0.1, 0.3, 0.2, 0.1]).select(post.ranked_by_label(post.attach(F.col("logits"), NAMES)).alias("p")).first()
    assert [p.species for p in row.p] == ["species2", "species3", "species1", "species0"]


def test_logit_edges(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (1.5,), (-0.1,), (0.83264834,)], "x double")
    got = [r.y for r in rows.select(scalar.logit(F.col("x")).alias("y")).collect()]
    assert got[0] == -math.inf and got[1] == math.inf and got[2] == 0
    assert math.isnan(got[3]) and math.isnan(got[4]) and got[5] == pytest.approx(1.604514, abs=1e-5)


def test_padding(spark):
    rows = spark.createDataFrame([([1.0, 2.0],)], "x array<float>")
    assert rows.select(scalar.padded(F.col("x"), 4).alias("y")).first().y == [1, 2, 0, 0]
    with pytest.raises(Exception, match="longer"):
        rows.select(scalar.padded(F.col("x"), 1).alias("y")).collect()


def test_comparison(spark):
    left = spark.createDataFrame([("a", 0.0, 3.0, 1, "x", 0.5), ("a", 0.0, 3.0, 2, "y", 0.4)], "path string, start_s double, end_s double, rank int, species string, confidence double")
    near = left.withColumn("confidence", F.col("confidence") + 1e-6)
    far = left.withColumn("confidence", F.col("confidence") + 1e-3)
    assert compare.equal(left, near) and not compare.equal(left, far)
    assert compare.differences(left, left.where("rank = 1")).count() == 1
    turned = left.withColumn("rank", 3 - F.col("rank"))
    assert not compare.equal(left, turned) and compare.misordered(turned).count() == 1


def test_matrix(spark):
    rows = spark.createDataFrame([("x", 0, 0.5), ("y", 1, 0.25), ("x", 1, 0.75)], "species string, chunk_idx int, confidence double")
    assert [tuple(r) for r in compare.matrix(rows, [0, 1]).collect()] == [("x", 0.5, 0.75), ("y", 0.0, 0.25)]
    assert [tuple(r) for r in compare.matrix(rows, [0, 1], species=["y", "z"]).collect()] == [("y", 0.0, 0.25), ("z", 0.0, 0.0)]
    with pytest.raises(NotImplementedError):
        compare.matrix(rows, [0], species=[])


def test_top_and_lookup(spark):
    rows = post.predictions(scored(spark, [0.1, 0.3, 0.2, 0.1], [0.9, 0.3, 0.2, 0.1]), NAMES, apply_sigmoid=False)
    assert [r.predictions[0].species for r in post.top(rows).orderBy("chunk_idx").collect()] == ["species2", "species1"]
    assert post.at_interval(rows, 3.0, 6.0).first().chunk_idx == 1
