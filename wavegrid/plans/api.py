"""Entry points: predictions within recordings, over many recordings, and at
places and times.

Parameters are checked when a plan is built; nothing runs before an action.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Collection
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid import params
from wavegrid.functions.scalar import passes, week_or_none
from wavegrid.operators import post
from wavegrid.runtime import is_file, ship
from wavegrid.sources import audio, models


def _band(scorer, use_bandpass: bool, fmin, fmax) -> tuple[float, float] | None:
    """The pass band, or None where it asks for no filter."""
    if not use_bandpass or fmax > scorer.sig_fmax or (fmin == scorer.sig_fmin and fmax == scorer.sig_fmax):
        return None
    return float(fmin), float(fmax)


def _plan(recordings: DataFrame, scorer, *, min_confidence, batch_size, chunk_overlap_s, use_bandpass, bandpass_fmin, bandpass_fmax, apply_sigmoid, sigmoid_sensitivity, species_filter) -> DataFrame:
    """(path, chunk_idx, start_s, end_s, predictions, error); only the allowed
    species' scores leave the scoring function."""
    wanted = set(species_filter or ())
    kept = [i for i, s in enumerate(scorer.species) if s in wanted] if wanted else None
    names = [scorer.species[i] for i in kept] if kept is not None else list(scorer.species)
    rows = audio.scores(recordings, scorer, overlap_s=chunk_overlap_s, batch_size=batch_size, band=_band(scorer, use_bandpass, bandpass_fmin, bandpass_fmax), wanted=kept)
    rows = post.predictions(rows, names, apply_sigmoid=apply_sigmoid, sensitivity=sigmoid_sensitivity or 1.0, min_confidence=min_confidence)
    if kept is not None:
        places = F.array(*map(F.lit, kept))
        rows = rows.withColumn("predictions", F.transform("predictions", lambda p: p.withField("label_idx", F.get(places, p["label_idx"]))))
    return rows


def predict_species_within_audio_file(
    spark: SparkSession,
    audio_file,
    /,
    *,
    scorer=None,
    min_confidence: float = 0.1,
    batch_size: int = 100,
    chunk_overlap_s: float = 0.0,
    use_bandpass: bool = True,
    bandpass_fmin: int | None = 0,
    bandpass_fmax: int | None = 15_000,
    apply_sigmoid: bool = True,
    sigmoid_sensitivity: float | None = 1.0,
    species_filter: Collection[str] | None = None,
) -> DataFrame:
    """Ranked predictions of each interval of one recording, in order of time.

    An interval without a prediction keeps its row.  A recording that can't be
    used makes the action fail.  Without a ``scorer`` the stock classifier is used
    from its staged folder (see :mod:`wavegrid.sources.models`)."""
    params.check_file(audio_file)
    scorer = models.make("saved-model") if scorer is None else scorer
    settings = {"min_confidence": min_confidence, "batch_size": batch_size, "chunk_overlap_s": chunk_overlap_s, "use_bandpass": use_bandpass, "bandpass_fmin": bandpass_fmin, "bandpass_fmax": bandpass_fmax, "apply_sigmoid": apply_sigmoid, "sigmoid_sensitivity": sigmoid_sensitivity}
    params.check_audio(**settings)
    params.check_subset(species_filter, scorer.species)
    rows = _plan(audio.files(spark, str(Path(audio_file).resolve().as_uri())), scorer, species_filter=species_filter, **settings)
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("bigint")).otherwise(F.col("chunk_idx"))
    return post.sorted_intervals(rows.withColumn("chunk_idx", checked).drop("error"))


def predict_species_within_audio_files(
    spark: SparkSession,
    audio_files: Collection | str,
    /,
    *,
    scorer=None,
    min_confidence: float = 0.1,
    batch_size: int = 1,
    chunk_overlap_s: float = 0.0,
    use_bandpass: bool = True,
    bandpass_fmin: int | None = 0,
    bandpass_fmax: int | None = 15_000,
    apply_sigmoid: bool = True,
    sigmoid_sensitivity: float | None = 1.0,
    species_filter: Collection[str] | None = None,
    custom_n_jobs: int | None = None,
    maxtasksperchild: int | None = None,
) -> DataFrame:
    """Predictions of many recordings, in no order; a recording that fails has
    one row with its error and no interval, also one that isn't there.

    ``audio_files`` are paths (repeated ones give repeated rows) or one glob for
    Spark.  ``custom_n_jobs`` lowers the number of tasks, and there are no more than
    paths; ``maxtasksperchild`` is checked and has no effect, as Spark manages its
    workers.  Without a ``scorer`` the stock classifier in TFLite form is used from
    its staged folder."""
    scorer = models.make("tflite") if scorer is None else scorer
    params.check_single_thread(scorer)
    settings = {"min_confidence": min_confidence, "batch_size": batch_size, "chunk_overlap_s": chunk_overlap_s, "use_bandpass": use_bandpass, "bandpass_fmin": bandpass_fmin, "bandpass_fmax": bandpass_fmax, "apply_sigmoid": apply_sigmoid, "sigmoid_sensitivity": sigmoid_sensitivity}
    params.check_audio(**settings)
    params.check_parallel(custom_n_jobs=custom_n_jobs, maxtasksperchild=maxtasksperchild)
    params.check_subset(species_filter, scorer.species)
    if isinstance(audio_files, str):
        recordings, lost = audio.files(spark, audio_files), None
    else:
        paths = [str(p) for p in audio_files]
        uris = [p if "://" in p else Path(p).resolve().as_uri() for p in paths]
        asked = [(p, u.replace("file:///", "file:/"), is_file(spark, u)) for p, u in zip(paths, uris)]
        table = spark.createDataFrame(asked, "asked string, path string, there boolean") if asked else spark.createDataFrame([], "asked string, path string, there boolean")
        lost = table.where("not there").select(F.col("asked").alias("path"), F.lit("there is no such file").alias("error"))
        there = sorted({uri for _, uri, found in asked if found})
        recordings = audio.files(spark, there) if there else spark.createDataFrame([], "path string, content binary")
        if len(there) < sum(found for *_, found in asked):  # some are given again
            recordings = recordings.join(table.where("there").groupBy("path").agg(F.count("*").cast("int").alias("times")), "path")
            recordings = recordings.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).drop("time", "times")
        if custom_n_jobs is not None:
            custom_n_jobs = max(1, min(custom_n_jobs, len(paths)))
    if custom_n_jobs is not None:
        recordings = recordings.coalesce(custom_n_jobs)
    rows = _plan(recordings, scorer, species_filter=species_filter, **settings)
    return rows if lost is None else rows.unionByName(lost, allowMissingColumns=True)


def failures(rows: DataFrame) -> DataFrame:
    """(path, error) of recordings that failed."""
    return rows.where("error is not null").select("path", "error")


def _score_places(scorer):
    def run(batches):
        for frame in batches:
            samples = frame[["latitude", "longitude", "week"]].to_numpy(dtype=np.float32)
            out = np.asarray(scorer.predict_species(samples), np.float32) if len(frame) else np.zeros((0, len(scorer.species)), np.float32)
            yield pd.DataFrame({"req_id": frame["req_id"], "latitude": frame["latitude"], "longitude": frame["longitude"], "week": frame["week"], "scores": list(out)})

    return run


def is_place(latitude: Column, longitude: Column, week: Column) -> Column:
    """Whether a row's place and week (null: none) are in range."""
    fine = latitude.between(-90, 90) & longitude.between(-180, 180) & F.coalesce(week.between(1, 48), F.lit(True))
    return F.coalesce(fine, F.lit(False))


def predict_locations(requests: DataFrame, scorer, *, min_confidence: float = 0.03) -> DataFrame:
    """(req_id, latitude, longitude, week, predictions) for a table of places and
    weeks; a row out of range makes the action fail, a null week is none."""
    params.check_confidence(min_confidence)
    ship(requests.sparkSession)
    fine = is_place(F.col("latitude"), F.col("longitude"), F.col("week"))
    checked = F.when(fine, week_or_none(F.col("week"))).otherwise(F.raise_error(F.lit("a place or week is out of range")).cast("int"))
    rows = requests.select("req_id", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), checked.alias("week"))
    rows = rows.mapInPandas(_score_places(scorer), "req_id bigint, latitude double, longitude double, week int, scores array<float>")
    found = post.attach(F.col("scores"), list(scorer.species))
    found = F.filter(found, lambda p: passes(p["confidence"], min_confidence))
    week = F.when(F.col("week") >= 0, F.col("week"))
    return rows.select("req_id", "latitude", "longitude", week.alias("week"), post.ranked_by_label(found).alias("predictions"))


def predict_species_at_location_and_time(spark: SparkSession, latitude: float, longitude: float, /, *, scorer=None, week: int | None = None, min_confidence: float = 0.03) -> OrderedDict:
    """Species and confidences at one place, best first, label order among equal
    ones."""
    params.check_location(latitude=latitude, longitude=longitude, week=week, min_confidence=min_confidence)
    scorer = models.make("geo-saved-model") if scorer is None else scorer
    request = spark.createDataFrame([(0, float(latitude), float(longitude), week)], "req_id bigint, latitude double, longitude double, week int")
    row = predict_locations(request, scorer, min_confidence=min_confidence).first()
    return OrderedDict((p["species"], p["confidence"]) for p in row["predictions"])


def as_ordered(rows: DataFrame) -> OrderedDict:
    """One recording's predictions as {(start, end): {species: confidence}}, for
    results that fit the driver."""
    out: OrderedDict = OrderedDict()
    for r in rows.orderBy("chunk_idx").select("start_s", "end_s", "predictions").toLocalIterator():
        out[(r["start_s"], r["end_s"])] = OrderedDict((p["species"], p["confidence"]) for p in r["predictions"])
    return out
