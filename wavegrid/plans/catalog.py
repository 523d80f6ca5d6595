"""The catalogue of named queries over the stand-in tables, and their oracles.

``embeddings`` stands for score vectors (its label is the recording, its id the
place of the interval), ``documents`` for recordings of n_chars / 100 seconds and
for label files, ``events`` for scalars and parameters, ``part`` and
``customer`` for names.
"""

from __future__ import annotations

import io
import uuid
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.functions import dsp, scalar
from wavegrid.operators import compare, grid, post
from wavegrid.plans import api
from wavegrid.runtime import put, shared_dir, ship
from wavegrid.scorers import ConstantScorer, GaussianGeoScorer, LinearScorer
from wavegrid.sources import audio, labels

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Species of the stand-in score vectors.
NAMES = [f"s{i:02d}" for i in range(64)]


def query(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score vectors as intervals of recordings."""
    rows = table(spark, sf_dir, "embeddings")
    start = F.col("vec_id") * F.lit(3.0)
    return rows.select(F.col("label").cast("string").alias("path"), F.col("vec_id").alias("chunk_idx"), start.alias("start_s"), (start + 3.0).alias("end_s"), F.col("embedding").alias("logits"))


def rounded(column: str, places: int = 6):
    return F.round(F.col(column).cast("double"), places)


_CHUNKS = """
chunks as (
  select label::varchar as path, vec_id as chunk_idx, vec_id * 3e0 as start_s, vec_id * 3e0 + 3e0 as end_s,
         unnest(range(0, 64)) as i, unnest(embedding) as logit from embeddings
), named as (select *, 's' || lpad(i::varchar, 2, '0') as species from chunks)
"""


def _sigmoid(x: str, s: float) -> str:
    return f"(1e0 / (1e0 + exp(-{s}e0 * greatest(-15e0, least(15e0, {x}::double)))))"


# Whole pipeline after scoring.


@query(
    "audio_predict_long",
    f"""with {_CHUNKS}, c as (select *, {_sigmoid("logit", 1.0)}::float as c from named)
select path, chunk_idx, start_s, end_s, row_number() over (partition by path, chunk_idx order by c desc, species) as rank,
       species, round(c::double, 6) as confidence
from c where c::double >= 0.55e0""",
)
def audio_predict_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = post.predictions(scored(spark, sf_dir), NAMES, min_confidence=0.55)
    rows = post.long_form(rows, outer=False)
    return rows.select("path", "chunk_idx", "start_s", "end_s", F.col("rank").cast("long").alias("rank"), "species", rounded("confidence").alias("confidence"))


@query(
    "species_rollup",
    f"""with {_CHUNKS}, c as (select *, {_sigmoid("logit", 1.0)}::float as c from named)
select path, species, count(*) as n, round(max(c)::double, 6) as best from c where c::double >= 0.55e0 group by path, species""",
)
def species_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = post.long_form(post.predictions(scored(spark, sf_dir), NAMES, min_confidence=0.55), outer=False)
    return rows.groupBy("path", "species").agg(F.count("*").alias("n"), F.max("confidence").alias("best")).withColumn("best", rounded("best"))


@query(
    "top1",
    f"""with {_CHUNKS}, c as (select *, {_sigmoid("logit", 1.0)}::float as c from named),
r as (select *, row_number() over (partition by path, chunk_idx order by c desc, species) as n from c)
select path, chunk_idx, species, round(c::double, 6) as confidence from r where n = 1""",
)
def top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = post.long_form(post.top(post.predictions(scored(spark, sf_dir), NAMES, min_confidence=0)), outer=False)
    return rows.select("path", "chunk_idx", "species", rounded("confidence").alias("confidence"))


@query(
    "empty_intervals",
    f"""with {_CHUNKS}, k as (select path, chunk_idx, species, logit from named where logit::double >= 0.4e0)
select v.label::varchar as path, v.vec_id as chunk_idx, k.species, round(k.logit::double, 6) as confidence
from embeddings v left join k on k.chunk_idx = v.vec_id""",
)
def empty_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = post.long_form(post.predictions(scored(spark, sf_dir), NAMES, apply_sigmoid=False, min_confidence=0.4))
    return rows.select("path", "chunk_idx", "species", rounded("confidence").alias("confidence"))


@query(
    "filter_conf_zero",
    f"""with {_CHUNKS} select path, chunk_idx, count(*) as n, count_if(logit < 0)::bigint as negative from named group by path, chunk_idx""",
)
def filter_conf_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = post.predictions(scored(spark, sf_dir), NAMES, apply_sigmoid=False, min_confidence=0)
    negative = F.size(F.filter("predictions", lambda p: p["confidence"] < 0))
    return rows.select("path", "chunk_idx", F.size("predictions").cast("long").alias("n"), negative.cast("long").alias("negative"))


@query(
    "filter_species",
    f"""with {_CHUNKS} select path, chunk_idx, species, round(logit::double, 6) as confidence from named
where species in ('s03', 's17', 's42') and logit::double >= 0.05e0""",
)
def filter_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = post.predictions(scored(spark, sf_dir), NAMES, apply_sigmoid=False, min_confidence=0.05, wanted={"s03", "s17", "s42"})
    return post.long_form(rows, outer=False).select("path", "chunk_idx", "species", rounded("confidence").alias("confidence"))


@query(
    "attach_labels",
    f"""with {_CHUNKS} select path, chunk_idx, i::integer as label_idx, species, round(logit::double, 6) as score from named""",
)
def attach_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame(list(enumerate(NAMES)), "label_idx int, species string")
    rows = post.attach_long(scored(spark, sf_dir).select("path", "chunk_idx", "logits"), names)
    return rows.select("path", "chunk_idx", "label_idx", "species", rounded("score").alias("score"))


def _sigmoid_query(name: str, s: float) -> None:
    @query(name, f"""with {_CHUNKS} select path, chunk_idx, species, round({_sigmoid("logit", s)}::float::double, 6) as confidence from named""")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scored(spark, sf_dir).withColumn("predictions", post.calibrated(post.attach(F.col("logits"), NAMES), s)).drop("logits")
        return post.long_form(rows, outer=False).select("path", "chunk_idx", "species", rounded("confidence").alias("confidence"))


for _name, _s in (("sigmoid_s05", 0.5), ("sigmoid_s10", 1.0), ("sigmoid_s15", 1.5)):
    _sigmoid_query(_name, _s)


# Grids.


def _grid_query(name: str, overlap: float) -> None:
    step = 3.0 - overlap

    @query(
        name,
        f"""with d as (select doc_id, n_chars / 100e0 as t from documents where n_chars > 0),
g as (select doc_id, t, unnest(range(0, 1 + greatest(0, ceil((t - 3e0) / {step}e0)::bigint))) as i from d)
select doc_id, i as chunk_idx, i * {step}e0 as start_s, least(i * {step}e0 + 3e0, t) as end_s from g""",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / F.lit(100.0)).alias("duration_s"))
        return grid.bounded(rows, key="doc_id", overlap_s=overlap).select("doc_id", "chunk_idx", "start_s", "end_s")


for _name, _s in (("chunk_grid_o0", 0.0), ("chunk_grid_o0p5", 0.5), ("chunk_grid_o1", 1.0), ("chunk_grid_o1p5", 1.5), ("chunk_grid_o2", 2.0)):
    _grid_query(_name, _s)


@query(
    "chunk_grid_o2p6",
    """with recursive g(doc_id, i, s, t) as (
  select doc_id, 0::bigint, 0e0, n_chars / 100e0 from documents where n_chars > 0
  union all select doc_id, i + 1, s + (3e0 - 2.6e0), t from g where s + 3e0 < t
)
select doc_id, i as chunk_idx, s as start_s, least(s + 3e0, t) as end_s from g""",
)
def chunk_grid_o2p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step whose sums are not exact: starts are added up one by one."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / F.lit(100.0)).alias("duration_s"))
    return grid.bounded(rows, key="doc_id", overlap_s=2.6).select("doc_id", "chunk_idx", "start_s", "end_s")


@query("chunk_count", """select doc_id, 1 + greatest(0, ceil((n_chars / 100e0 - 3e0) / 1.5e0)::bigint) as n from documents""")
def chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", grid.chunk_count(F.col("n_chars") / F.lit(100.0), overlap_s=1.5).alias("n"))


@query(
    "chunk_unbounded",
    """select doc_id, i as chunk_idx, 1.25e0 + i * 1.5e0 as start_s, 1.25e0 + i * 1.5e0 + 2e0 as end_s
from (select doc_id, unnest(range(0, 5)) as i from documents)""",
)
def chunk_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return grid.unbounded(rows, n=5, chunk_s=2.0, overlap_s=0.5, start=1.25, key="doc_id").select("doc_id", "chunk_idx", "start_s", "end_s")


@query(
    "chunk_legacy",
    """with d as (select doc_id, n_chars as n, round_even((n_chars - 300 + 200 - 1) / 200e0, 0)::bigint * 200 as near from documents),
p as (select doc_id, case when near < 0 then 0 when n - near < 100 then near - 200 else near end as last from d),
g as (select doc_id, unnest(range(0, last + 1, 200)) as position from p where last >= 0)
select doc_id, position // 200 as chunk_idx, position, (position // 200) * 2e0 as start_s, (position // 200) * 2e0 + 3e0 as end_s from g""",
)
def chunk_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n_samples"))
    return grid.legacy(rows, rate=100, chunk_s=3.0, overlap_s=1.0, least_s=1.0, key="doc_id").select("doc_id", "chunk_idx", "position", "start_s", "end_s")


@query("interval_lookup", """select doc_id, 1::bigint as chunk_idx from documents where n_chars / 100e0 >= 6e0""")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / F.lit(100.0)).alias("duration_s"))
    return post.at_interval(grid.bounded(rows, key="doc_id"), 3.0, 6.0).select("doc_id", "chunk_idx")


@query(
    "frame_bounds_half_even",
    """select event_id, round_even(value * 22050e0, 0)::bigint as start_frame, round_even((value + 2.25e0) * 22050e0, 0)::bigint as end_frame from events""",
)
def frame_bounds_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("start_s"), (F.col("value") + 2.25).alias("end_s"))
    return grid.frames(rows, 22_050).select("event_id", "start_frame", "end_frame")


@query("resample_length", """select doc_id, round_even(n_chars / 44100e0 * 48000e0, 0)::bigint as n from documents""")
def resample_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalar.resampled_length(F.col("n_chars").cast("double"), F.lit(44_100.0), 48_000.0).alias("n"))


@query(
    "batching",
    """select label::varchar as path, vec_id // 8 as batch, count(*) as n, min(vec_id) as first, max(vec_id) as last from embeddings group by all""",
)
def batching(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.batches(scored(spark, sf_dir), 8)
    return rows.select("path", "batch", F.size("members").cast("long").alias("n"), F.element_at("members", 1).alias("first"), F.element_at("members", -1).alias("last"))


# Arrays and scalars.


@query("pad_silence", """select vec_id, 100::bigint as n, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as sum, 0e0 as last from embeddings""")
def pad_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", scalar.padded(F.col("embedding"), 100).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b.cast("double"))
    return rows.select("vec_id", F.size("x").cast("long").alias("n"), F.round(total, 4).alias("sum"), F.element_at("x", -1).cast("double").alias("last"))


@query("slice_frames", """select vec_id, len(embedding[5:8]) as n, embedding[5] as first, embedding[8] as last from embeddings""")
def slice_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", grid.slice_frames(F.col("embedding"), F.lit(4), F.lit(8)).alias("x"))
    return rows.select("vec_id", F.size("x").cast("long").alias("n"), F.element_at("x", 1).alias("first"), F.element_at("x", -1).alias("last"))


@query(
    "sigmoid_clip",
    f"""select event_id, round({_sigmoid("value - 250", 0.5)}, 6) as s05, round({_sigmoid("value - 250", 1.0)}, 6) as s10, round({_sigmoid("value - 250", 1.5)}, 6) as s15 from events""",
)
def sigmoid_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value") - 250
    return table(spark, sf_dir, "events").select("event_id", *(F.round(scalar.flat_sigmoid(x, s), 6).alias(n) for n, s in (("s05", 0.5), ("s10", 1.0), ("s15", 1.5))))


@query(
    "logit_edges",
    """with x as (select event_id, greatest(0e0, least(1e0, (value - 50e0) / 400e0)) as x from events)
select event_id, case when x = 0 then '-inf' when x = 1 then 'inf' else 'finite' end as kind,
       case when x > 0 and x < 1 then round(ln(x / (1e0 - x)), 5) end as logit from x""",
)
def logit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - 50.0) / F.lit(400.0)))
    rows = table(spark, sf_dir, "events").select("event_id", scalar.logit(x).alias("y"))
    low, high = F.col("y") == F.lit(float("-inf")), F.col("y") == F.lit(float("inf"))
    return rows.select("event_id", F.when(low, "-inf").when(high, "inf").otherwise("finite").alias("kind"), F.when(~low & ~high, F.round("y", 5)).alias("logit"))


@query("filter_conf_float_edge", """select event_id from events where (round_even(value / 50e0, 0) / 10e0)::float::double >= 0.7e0""")
def filter_conf_float_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A float32 score of 0.7 lies below the double 0.7."""
    score = (F.rint(F.col("value") / F.lit(50.0)) / F.lit(10.0)).cast("float")
    return table(spark, sf_dir, "events").where(scalar.passes(score, 0.7)).select("event_id")


@query(
    "location_params",
    """select event_id, coalesce((value - 100e0 between -90 and 90) and (value - 250e0 between -180 and 180) and (week is null or week between 1 and 48), false) as inside, coalesce(week, -1) as week
from (select *, case when event_id % 5 > 0 then (event_id % 51 + 1)::integer end as week from events)""",
)
def location_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 51 + 1)
    inside = api.is_place(F.col("value") - 100, F.col("value") - 250, week)
    return table(spark, sf_dir, "events").select("event_id", inside.alias("inside"), scalar.week_or_none(week).alias("week"))


@query("week_of_year48", """select o_orderkey, ((month(o_orderdate) - 1) * 4 + least(4, (day(o_orderdate) - 1) // 7 + 1))::integer as week from orders""")
def week_of_year48(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.week48(F.col("o_orderdate")).alias("week"))


@query(
    "bandpass_branch",
    """select * from (values (0, 15000, 'none'), (5000, 15000, 'highpass'), (0, 10000, 'lowpass'), (5000, 10000, 'bandpass'), (5000, 16000, 'none')) t(fmin, fmax, action)""",
)
def bandpass_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(0, 15000), (5000, 15000), (0, 10000), (5000, 10000), (5000, 16000)], "fmin int, fmax int")
    return rows.withColumn("action", scalar.band_action(F.col("fmin"), F.col("fmax"), 0, 15_000))


# Order, sets and comparison.


@query(
    "sort_ties",
    f"""with {_CHUNKS}, q as (select chunk_idx, species, (round_even(logit * 8e0, 0) / 8e0)::float as c from named)
select chunk_idx, species, row_number() over (partition by chunk_idx order by c desc, species desc) as rank, c::double as confidence from q""",
)
def sort_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few different scores, and labels in falling order, so that equal scores
    stand in the order of names only if they are sorted by them."""
    scores = F.transform("logits", lambda x: (F.rint(x.cast("double") * 8.0) / F.lit(8.0)).cast("float"))
    falling = [f"t{99 - int(n[1:]):02d}" for n in NAMES]
    rows = scored(spark, sf_dir).withColumn("logits", scores)
    rows = post.long_form(post.predictions(rows, falling, apply_sigmoid=False, min_confidence=0), outer=False)
    name = F.concat(F.lit("s"), F.lpad((99 - F.substring("species", 2, 2).cast("int")).cast("string"), 2, "0"))
    return rows.select("chunk_idx", name.alias("species"), F.col("rank").cast("long").alias("rank"), F.col("confidence").cast("double").alias("confidence"))


@query(
    "location_sort",
    f"""with {_CHUNKS}, q as (select chunk_idx, i, species, (round_even(logit * 20e0, 0) / 20e0)::float as c from named)
select chunk_idx, species, row_number() over (partition by chunk_idx order by c desc, i) as rank, c::double as confidence
from q where c::double >= 0.03e0""",
)
def location_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.transform("logits", lambda x: (F.rint(x.cast("double") * 20.0) / F.lit(20.0)).cast("float"))
    found = post.ranked_by_label(post.confident(post.attach(scores, NAMES), 0.03, always=True))
    rows = post.long_form(scored(spark, sf_dir).select("chunk_idx", found.alias("predictions")), outer=False)
    return rows.select("chunk_idx", "species", F.col("rank").cast("long").alias("rank"), F.col("confidence").cast("double").alias("confidence"))


@query("unknown_species", """select * from (values ('s64'), ('sparrow')) t(species)""")
def unknown_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("s00",), ("s63",), ("s64",), ("sparrow",)], "species string")
    return compare.unknown(wanted, spark.createDataFrame([(n,) for n in NAMES], "species string"))


@query("occurring_species", f"""with {_CHUNKS} select distinct species from named where logit::double >= 0.35e0""")
def occurring_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = post.predictions(scored(spark, sf_dir), NAMES, apply_sigmoid=False, min_confidence=0.35)
    return compare.occurring(post.long_form(rows))


@query(
    "matrix_pivot",
    f"""with {_CHUNKS}, kept as (select path, species, logit from named where logit::double >= 0.3e0),
paths as (select distinct path from kept), names as (select distinct species from named),
best as (select path, species, max(logit) as c from kept group by path, species)
select path, species, coalesce(c, 0)::float::double as confidence from paths cross join names left join best using (path, species)""",
)
def matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best confidence of each species in each recording, 0 where it is absent."""
    rows = post.long_form(post.predictions(scored(spark, sf_dir), NAMES, apply_sigmoid=False, min_confidence=0.3), outer=False)
    found = compare.matrix_long(rows, species=NAMES, index="path")
    return found.select("path", "species", F.col("confidence").cast("double").alias("confidence"))


@query(
    "matrix_wide",
    f"""with {_CHUNKS} select species, coalesce(max(case when chunk_idx = 3 and logit::double >= 0.1e0 then logit end), 0)::float as c3, coalesce(max(case when chunk_idx = 8 and logit::double >= 0.1e0 then logit end), 0)::float as c8 from named group by species""",
)
def matrix_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of two intervals."""
    rows = post.long_form(post.predictions(scored(spark, sf_dir), NAMES, apply_sigmoid=False, min_confidence=0.1), outer=False)
    wide = compare.matrix(rows, [3, 8], species=NAMES)
    return wide.select("species", F.col("3").alias("c3"), F.col("8").alias("c8"))


@query(
    "pred_equality",
    f"""with {_CHUNKS}, l as (select path, start_s, end_s, species, logit::double as c from named where logit::double >= 0.05e0),
r as (select path, start_s, end_s, species, (logit::double + case chunk_idx % 5 when 1 then 0.001e0 when 2 then 0.0000001e0 else 0e0 end) as c from named where chunk_idx % 11 <> 3 and logit::double >= 0.05e0)
select path, start_s, end_s, species, l.c is not null as in_left, r.c is not null as in_right from l full join r using (path, start_s, end_s, species)
where l.c is null or r.c is null or not (abs(l.c - r.c) <= greatest(1e-5, 1e-9 * greatest(abs(l.c), abs(r.c))))""",
)
def pred_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two result sets over the same recordings, by interval and species: the right
    one lacks some intervals, and in others its confidences are off by more or less
    than the tolerance."""
    rows = post.long_form(post.predictions(scored(spark, sf_dir), NAMES, apply_sigmoid=False, min_confidence=0.05), outer=False)
    shift = F.when(F.col("chunk_idx") % 5 == 1, 0.001).when(F.col("chunk_idx") % 5 == 2, 1e-7).otherwise(0.0)
    right = rows.where(F.col("chunk_idx") % 11 != 3).withColumn("confidence", F.col("confidence").cast("double") + shift)
    found = compare.differences(rows, right, decimals=5)
    return found.select(*compare.INTERVAL, "species", F.col("left_confidence").isNotNull().alias("in_left"), F.col("right_confidence").isNotNull().alias("in_right"))


@query(
    "order_checks",
    f"""with {_CHUNKS}, o as (select *, lag(logit) over w as before, lag(species) over w as name from named window w as (partition by path, chunk_idx order by i))
select path, count(*) as wrong from o where before < logit or before = logit and name > species group by path""",
)
def order_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = post.long_form(scored(spark, sf_dir).withColumn("predictions", post.attach(F.col("logits"), NAMES)).drop("logits"))
    return compare.misordered(rows).groupBy("path").agg(F.count("*").alias("wrong"))


@query(
    "interval_order_check",
    """select doc_id::varchar as path, 1 + greatest(0, ceil((n_chars / 100e0 - 3e0) / 3e0)::bigint) - 1 as wrong from documents where doc_id % 3 = 0 and n_chars > 300""",
)
def interval_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the recordings have their intervals numbered from the end."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), (F.col("n_chars") / F.lit(100.0)).alias("duration_s"), (F.col("doc_id") % 3 == 0).alias("turned"))
    rows = grid.bounded(rows).withColumn("chunk_idx", F.when(F.col("turned"), -F.col("chunk_idx")).otherwise(F.col("chunk_idx")))
    return compare.misordered_intervals(rows).groupBy("path").agg(F.count("*").alias("wrong"))


@query("nonzero_count", f"""with {_CHUNKS} select count_if(logit <> 0)::bigint as nonzero, count_if(logit > 0)::bigint as positive from named""")
def nonzero_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.nonzero(scored(spark, sf_dir).select(F.explode("logits").alias("x")), "x")


@query("ordered_distinct", """select source, min(doc_id) as doc_id from documents group by source""")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.distinct_in_order(table(spark, sf_dir, "documents"), "source", "doc_id")


@query(
    "label_subset",
    """select doc_id, source in ('src1', 'src2', 'src3') as known from documents""",
)
def label_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = compare.subset(F.array("source"), ["src1", "src2", "src3"])
    return table(spark, sf_dir, "documents").select("doc_id", known.alias("known"))


# Label files and names.


@query(
    "labels_splitlines",
    r"""with l as (select doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') as l from documents where text <> ''),
p as (select doc_id, unnest(l) as species, unnest(range(0, len(l))) as pos, len(l) as n from l),
m as (select doc_id, species, min(pos) as pos from p where not (pos = n - 1 and species = '') group by doc_id, species)
select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::integer as label_idx, species from m""",
)
def labels_splitlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.distinct_lines(table(spark, sf_dir, "documents"), keys=["doc_id"])


@query(
    "raven_two_fields",
    """select c_custkey::varchar as code, c_name || ', ' || c_mktsegment as species from customer""",
)
def raven_two_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label file of codes and quoted names with commas in them."""
    folder = f"{shared_dir(spark)}/wavegrid/code-csv-{uuid.uuid4().hex}"
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), F.col("c_name"), F.lit(", "), F.col("c_mktsegment"), F.lit('"'))
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(folder)
    return labels.read_code_csv(spark, folder)


@query(
    "species_split",
    """with s as (select p_partkey, string_split(replace(p_name, ' ', '_'), '_') as s from part)
select p_partkey, case when len(s) = 2 then s[1] end as scientific, case when len(s) = 2 then s[2] end as common from s""",
)
def species_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", labels.names(F.translate("p_name", " ", "_")).alias("n")).select("p_partkey", "n.*")


# Scorers, recordings and errors.


@query(
    "linear_head",
    """with e as (select vec_id, label, unnest(range(0, 64)) as i, unnest(embedding)::double as x from embeddings),
w as (select label, i, avg(x) as w from e group by label, i)
select e.vec_id, w.label, round(sum(e.x * w.w), 4) + 0e0 as logit from e join w on e.i = w.i group by e.vec_id, w.label""",
)
def linear_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a linear head whose weights are each label's mean vector; the head
    is as large as labels times places."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    places = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("w"))
    weights = places.toPandas().pivot(index="i", columns="label", values="w")
    scorer = LinearScorer([str(c) for c in weights.columns], weights=weights.to_numpy())

    def run(batches):
        for frame in batches:
            x = np.stack(frame["embedding"].to_numpy()).astype(np.float64) if len(frame) else np.zeros((0, len(weights)))
            yield pd.DataFrame({"vec_id": frame["vec_id"], "logits": list(scorer.head(x))})

    scores_ = rows.select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, logits array<double>")
    named = scores_.select("vec_id", F.posexplode("logits").alias("i", "logit"))
    return named.select("vec_id", F.get(F.array(*(F.lit(int(c)) for c in weights.columns)), F.col("i")).cast(rows.schema["label"].dataType).alias("label"), (F.round("logit", 4) + 0.0).alias("logit"))


def ramp(frames: int) -> bytes:
    """A WAV file at 48 kHz whose samples go from -50 to 49 again and again."""
    x = (np.arange(frames) % 100 - 50).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(48_000)
        file.writeframes(x.tobytes())
    return out.getvalue()


def _wav_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Paths of one recording for each of the 25 nations, written to the shared
    folder: 0.625 s for each nation up to it; of each five nations one's file is
    broken and one's is missing."""
    folder = f"{shared_dir(spark)}/wavegrid/recordings-{uuid.uuid4().hex}"
    paths = []
    for (key,) in table(spark, sf_dir, "nation").select("n_nationkey").collect():
        paths.append(f"{folder}/{key}.wav")
        if key % 5 < 4:
            put(spark, paths[-1], b"no sound" if key % 5 == 3 else ramp(30_000 * (key + 1)))
    return paths


def _nation(path: str = "path"):
    return F.regexp_extract(path, r"(\d+)\.wav$", 1).cast("int").alias("nation")


@query(
    "files_errors",
    """select n_nationkey::integer as nation, case when n_nationkey % 5 < 3 then 1 + greatest(0, ceil(((n_nationkey + 1) * 0.625e0 - 3e0) / 1.5e0)::bigint) else 0 end as intervals, n_nationkey % 5 >= 3 as failed from nation""",
)
def files_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions over real files, of which some are broken and some missing: the
    others' intervals, and the failures."""
    scorer = ConstantScorer(["a", "b"], scores=[0.5, 0.25])
    rows = api.predict_species_within_audio_files(spark, _wav_files(spark, sf_dir), scorer=scorer, chunk_overlap_s=1.5, apply_sigmoid=False, min_confidence=0, custom_n_jobs=2)
    good = rows.where("error is null").groupBy("path").agg(F.count("*").alias("intervals")).select(_nation(), "intervals", F.lit(False).alias("failed"))
    return good.unionByName(api.failures(rows).select(_nation(), F.lit(0).cast("long").alias("intervals"), F.lit(True).alias("failed")))


@query(
    "chunk_samples",
    """with f as (select n_nationkey as k, (n_nationkey + 1) * 0.625e0 as t from nation where n_nationkey % 5 < 3),
g as (select k, t, unnest(range(0, 1 + greatest(0, ceil((t - 3e0) / 2e0)::bigint))) as i from f),
b as (select k, i * 2e0 as start_s, least(i * 2e0 + 3e0, t) as end_s from g)
select k::integer as nation, start_s, end_s, round_even(end_s * 48000, 0)::bigint - round_even(start_s * 48000, 0)::bigint as n,
  list_sum(list_transform(range(round_even(start_s * 48000, 0)::bigint, round_even(end_s * 48000, 0)::bigint), lambda j: j % 100 - 50))::bigint as sum from b""",
)
def chunk_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by interval: their number and sum."""
    there = [p for p in _wav_files(spark, sf_dir) if int(p.rsplit("/", 1)[1][:-4]) % 5 < 3]
    rows = audio.chunks(audio.files(spark, there), overlap_s=1.0)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + F.rint(x.cast("double") * 32768.0))
    return rows.select(_nation(), "start_s", "end_s", F.size("samples").cast("long").alias("n"), total.cast("long").alias("sum"))


@query(
    "legacy_samples",
    """with p as (select vec_id, list_concat(embedding, list_transform(range(0, 30), lambda x: 0::float)) as x, unnest([0, 20, 40]) as position from embeddings)
select vec_id, position::bigint as position, position // 20 * 2e0 as start_s, position // 20 * 2e0 + 3e0 as end_s, 30::bigint as n, round(list_sum(list_transform(x[position + 1 : position + 30], lambda y: y::double)), 4) as sum, x[position + 30]::double as last from p""",
)
def legacy_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the older chunker, with silence behind the last sample: vectors are
    signals of 6.4 seconds at 10 Hz."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.size("embedding").alias("n_samples"))
    rows = grid.legacy(rows, rate=10, chunk_s=3.0, overlap_s=1.0, least_s=1.0, key="vec_id").withColumn("x", grid.cut(F.col("embedding"), F.col("position"), 30))
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b.cast("double"))
    return rows.select("vec_id", "position", "start_s", "end_s", F.size("x").cast("long").alias("n"), F.round(total, 4).alias("sum"), F.element_at("x", -1).cast("double").alias("last"))


@query(
    "interval_keyed",
    f"""with {_CHUNKS}, c as (select *, {_sigmoid("logit", 1.0)}::float as c from named)
select path, start_s, end_s, species, round(c::double, 6) as confidence from c where c::double >= 0.55e0 and start_s = 24 and end_s = 27""",
)
def interval_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions looked up by their interval."""
    rows = post.at_interval(post.predictions(scored(spark, sf_dir), NAMES, min_confidence=0.55), 24.0, 27.0)
    return post.long_form(rows, outer=False).select("path", "start_s", "end_s", "species", rounded("confidence").alias("confidence"))


def tone(seconds: float, rate: int, channels: int = 1, hertz: float = 1000.0) -> bytes:
    """A WAV file of a sine, 16 bits a sample."""
    n = round(seconds * rate)
    x = np.round(np.sin(2 * np.pi * hertz * np.arange(n) / rate) * 16384).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(channels)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes(np.repeat(x, channels).tobytes())
    return out.getvalue()


def _recordings(spark: SparkSession) -> DataFrame:
    ship(spark)
    made = [("a48k", tone(10, 48_000)), ("b44k1", tone(7.5, 44_100)), ("c11k", tone(7.5, 11_025)), ("short", tone(1, 48_000)), ("stereo", tone(2, 48_000, 2)), ("empty", tone(0, 48_000)), ("junk", b"no sound")]
    return spark.createDataFrame([(p, bytearray(c)) for p, c in made], "path string, content binary")


@query(
    "audio_probe",
    """select * from (values ('a48k', 48000, 480000, 10e0, true), ('b44k1', 44100, 330750, 7.5e0, true), ('c11k', 11025, 82688, 82688 / 11025e0, true), ('short', 48000, 48000, 1e0, true),
('stereo', -1, -1, -1e0, false), ('empty', -1, -1, -1e0, false), ('junk', -1, -1, -1e0, false)) t(path, sample_rate, n_frames, duration_s, good)""",
)
def audio_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio.probe(_recordings(spark))
    good = F.col("error").isNull()
    return found.select("path", F.coalesce("sample_rate", F.lit(-1)).alias("sample_rate"), F.coalesce(F.col("n_frames").cast("int"), F.lit(-1)).alias("n_frames"), F.coalesce("duration_s", F.lit(-1.0)).alias("duration_s"), good.alias("good"))


@query(
    "audio_wav_e2e",
    """with f(path, t) as (values ('a48k', 10e0), ('b44k1', 7.5e0), ('c11k', 82688 / 11025e0), ('short', 1e0)),
g as (select path, t, unnest(range(0, 1 + greatest(0, ceil((t - 3e0) / 1.5e0)::bigint))) as i from f),
s(species, rank, confidence) as (values ('species2', 1, 0.3), ('species3', 2, 0.2), ('species0', 3, 0.1), ('species1', 4, 0.1))
select path, i as chunk_idx, i * 1.5e0 as start_s, least(i * 1.5e0 + 3e0, t) as end_s, rank::integer as rank, species, confidence::double as confidence, null::varchar as error from g, s
union all select path, -1, null, null, -1, null, null, 'failed' from (values ('stereo'), ('empty'), ('junk')) t(path)""",
)
def audio_wav_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    scorer = ConstantScorer(["species1", "species2", "species3", "species0"], scores=[0.1, 0.3, 0.2, 0.1])
    rows = audio.scores(_recordings(spark), scorer, overlap_s=1.5)
    rows = post.long_form(post.predictions(rows, scorer.species, apply_sigmoid=False, min_confidence=0))
    failed = F.when(F.col("error").isNotNull(), "failed")
    return rows.select("path", F.coalesce("chunk_idx", F.lit(-1)).cast("long").alias("chunk_idx"), "start_s", "end_s", F.coalesce("rank", F.lit(-1)).alias("rank"), "species", rounded("confidence", 4).alias("confidence"), failed.alias("error"))


@query(
    "location_predict",
    """with s(species, lat, lon, best, i) as (values ('north', 60e0, 10e0, 20e0, 0), ('south', -30e0, 20e0, 4e0, 1), ('east', 30e0, 170e0, 30e0, 2)),
d as (select c_custkey as req_id, (c_custkey % 180 - 90)::double as lat, (c_custkey * 7 % 360 - 180)::double as lon, case when c_custkey % 4 > 0 then c_custkey % 48 + 1 end as week from customer),
v as (select req_id, species, i, week::integer as week, exp(-far) * case when week is null then 1e0 else 0.6e0 + 0.4e0 * cos((week - best) * 2 * pi() / 48) end as c from
  (select req_id, s.species, s.i, d.week, s.best, ((d.lat - s.lat) * (d.lat - s.lat) + pow(((d.lon - s.lon + 900e0) % 360e0) - 180e0, 2)) / 1600e0 as far from d, s))
select req_id, coalesce(week, -1) as week, species, round(c, 4) as confidence from v where c::float::double >= 0.03e0""",
)
def location_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(key.alias("req_id"), (key % 180 - 90).cast("double").alias("latitude"), (key * 7 % 360 - 180).cast("double").alias("longitude"), F.when(key % 4 > 0, (key % 48 + 1).cast("int")).alias("week"))
    scorer = GaussianGeoScorer(["north", "south", "east"], np.array([[60, 10, 20], [-30, 20, 4], [30, 170, 30]]), 40.0)
    rows = api.predict_locations(asked, scorer, min_confidence=0.03)
    return rows.select("req_id", F.coalesce("week", F.lit(-1)).alias("week"), F.explode("predictions").alias("p")).select("req_id", "week", F.col("p.species").alias("species"), F.round(F.col("p.confidence").cast("double"), 4).alias("confidence"))


@query("dsp_filter", """select * from (values ('bandpass', 5000, 0.71e0), ('bandpass', 10000, 0.71e0), ('highpass', 10000, 0.71e0), ('lowpass', 10000, 0.71e0), ('none', 12000, 1e0)) t(action, hertz, gain)""")
def dsp_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain of steady sines at the cut-offs, 3 dB down."""
    rows = spark.createDataFrame([("bandpass", 5000), ("bandpass", 10000), ("highpass", 10000), ("lowpass", 10000), ("none", 12000)], "action string, hertz int")
    bands = {"bandpass": (5000, 10000), "highpass": (10000, 15000), "lowpass": (0, 10000), "none": (0, 15000)}
    ship(spark)

    def run(batches):
        for frame in batches:
            gains = []
            for action, hertz in zip(frame["action"], frame["hertz"]):
                x = np.sin(2 * np.pi * hertz * np.arange(24_000) / 48_000)
                y = dsp.filtered(x[None], 48_000, *bands[action], 0, 15_000)[0]
                gains.append(round(float(np.sqrt(np.mean(y[12_000:].astype(float) ** 2) * 2)), 2))
            yield pd.DataFrame({"action": frame["action"], "hertz": frame["hertz"], "gain": gains})

    return rows.mapInPandas(run, "action string, hertz int, gain double")


@query("fft_resample", """select * from (values (44100, 144000, 0e0), (22050, 144000, 0e0), (96000, 144000, 0e0)) t(rate, n, error)""")
def fft_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three seconds of a sine at other rates, against the sine at 48 kHz."""
    rows = spark.createDataFrame([(44_100,), (22_050,), (96_000,)], "rate int")
    ship(spark)

    def run(batches):
        want = np.sin(2 * np.pi * 1000 * np.arange(144_000) / 48_000)
        for frame in batches:
            made = [dsp.resample(np.sin(2 * np.pi * 1000 * np.arange(3 * r) / r).astype(np.float32), r, 48_000) for r in frame["rate"]]
            yield pd.DataFrame({"rate": frame["rate"], "n": [len(y) for y in made], "error": [round(float(np.abs(y - want).max()), 4) + 0.0 for y in made]})

    return rows.mapInPandas(run, "rate int, n int, error double")

