"""From score vectors to ranked predictions, in arrays within each row.

Nothing here shuffles: a row keeps its interval however many predictions it has,
also none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.functions.scalar import flat_sigmoid, passes


def attach(scores: Column, labels: list[str], wanted: set[str] | None = None) -> Column:
    """Array of (species, confidence, label_idx), label order.

    The shorter side ends the list.  With ``wanted``, only its labels' scores
    are taken out of the vector."""
    if wanted:
        picked = [(i, s) for i, s in enumerate(labels) if s in wanted]
        named = F.array(*(F.struct(F.lit(s).alias("species"), F.get(scores, F.lit(i)).cast("float").alias("confidence"), F.lit(i).alias("label_idx"), F.lit(i).alias("at")) for i, s in picked))
        kept = F.filter(named, lambda x: x["at"] < F.size(scores))
        return F.transform(kept, lambda x: F.struct(x["species"].alias("species"), x["confidence"].alias("confidence"), x["label_idx"].alias("label_idx")))
    names = F.array(*map(F.lit, labels)) if labels else F.array().cast("array<string>")
    size = F.least(F.size(scores), F.lit(len(labels)))
    both = F.zip_with(F.slice(scores, F.lit(1), size), F.slice(names, F.lit(1), size), lambda c, s: F.struct(s.alias("species"), c.cast("float").alias("confidence")))
    return F.transform(both, lambda x, i: F.struct(x["species"].alias("species"), x["confidence"].alias("confidence"), i.alias("label_idx")))


def attach_long(scores: DataFrame, labels: DataFrame, *, column: str = "logits") -> DataFrame:
    """One row per score, joined with (label_idx, species)."""
    keep = [c for c in scores.columns if c != column]
    rows = scores.select(*keep, F.posexplode(column).alias("label_idx", "score"))
    return rows.join(F.broadcast(labels) if labels.isLocal() else labels, "label_idx")


def calibrated(predictions: Column, sensitivity: float = 1.0) -> Column:
    """Confidences through the flat sigmoid."""
    return F.transform(predictions, lambda p: p.withField("confidence", flat_sigmoid(p["confidence"], sensitivity).cast("float")))


def confident(predictions: Column, least: float, *, always: bool = False) -> Column:
    """Predictions of ``least`` or more; 0 is no filter unless ``always``."""
    return predictions if least == 0 and not always else F.filter(predictions, lambda p: passes(p["confidence"], least))


def allowed(predictions: Column, wanted: set[str] | None) -> Column:
    """Predictions of wanted species; none wanted is no filter."""
    return F.filter(predictions, lambda p: p["species"].isin(*sorted(wanted))) if wanted else predictions


def ranked(predictions: Column) -> Column:
    """By falling confidence, then by name; NaN last."""

    def order(x: Column, y: Column) -> Column:
        a, b = x["confidence"], y["confidence"]
        worse = F.isnan(a) & ~F.isnan(b) | ~F.isnan(b) & (a < b)
        better = F.isnan(b) & ~F.isnan(a) | ~F.isnan(a) & (a > b)
        return F.when(worse, 1).when(better, -1).when(x["species"] < y["species"], -1).when(x["species"] > y["species"], 1).otherwise(0)

    return F.array_sort(predictions, order)


def ranked_by_label(predictions: Column) -> Column:
    """By falling confidence, equal ones in label order."""

    def order(x: Column, y: Column) -> Column:
        a, b = x["confidence"], y["confidence"]
        return F.when(a < b, 1).when(a > b, -1).otherwise(x["label_idx"] - y["label_idx"])

    return F.array_sort(predictions, order)


def predictions(scores: DataFrame, labels: list[str], *, column: str = "logits", apply_sigmoid: bool = True, sensitivity: float = 1.0, min_confidence: float = 0.1, wanted: set[str] | None = None) -> DataFrame:
    """Replaces the score vector by ranked predictions: sigmoid, confidence,
    names, order."""
    found = attach(F.col(column), labels, set(wanted or ()))
    if apply_sigmoid:
        found = calibrated(found, sensitivity)
    found = ranked(allowed(confident(found, min_confidence), wanted))
    return scores.withColumn("predictions", found).drop(column)


def long_form(rows: DataFrame, *, outer: bool = True) -> DataFrame:
    """One row per prediction, with its rank from 1; with ``outer`` an interval
    without predictions keeps a row of nulls."""
    keep = [c for c in rows.columns if c != "predictions"]
    explode = F.posexplode_outer if outer else F.posexplode
    out = rows.select(*keep, explode("predictions").alias("pos", "p"))
    return out.select(*keep, (F.col("pos") + 1).alias("rank"), F.col("p.species").alias("species"), F.col("p.confidence").alias("confidence"))


def top(rows: DataFrame, k: int = 1) -> DataFrame:
    """The first ``k`` predictions of each interval."""
    return rows.withColumn("predictions", F.slice("predictions", 1, k))


def at_interval(rows: DataFrame, start_s: float, end_s: float) -> DataFrame:
    """The rows of one interval, by exact bounds."""
    return rows.where((F.col("start_s") == F.lit(float(start_s))) & (F.col("end_s") == F.lit(float(end_s))))


def sorted_intervals(rows: DataFrame) -> DataFrame:
    """Ordered by recording and interval, as a sink may want them."""
    return rows.orderBy("path", "chunk_idx")
