"""Grids of overlapping intervals, and slicing and batching along them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.functions.scalar import frame_at, padded


def _dyadic(x: float) -> bool:
    """Whether multiples of x are exact: few enough binary places."""
    return (x * 2.0**20).is_integer()


_sums: dict[float, np.ndarray] = {}


def _added_up(step: float):
    """Function from n to the sum of n steps, added up one by one.  A worker keeps
    the sums as far as it has needed them."""

    @F.pandas_udf("double")
    def run(n: pd.Series) -> pd.Series:
        most = int(n.max()) if len(n) else 0
        if len(_sums.get(step, ())) <= most:
            _sums[step] = np.cumsum(np.concatenate([[0.0], np.full(max(1024, 2 * most), step)]))
        return pd.Series(_sums[step][n.to_numpy(np.int64)])

    return run


def _check(chunk_s: float, overlap_s: float) -> float:
    if not chunk_s > 0 or not 0 <= overlap_s < chunk_s:
        raise ValueError("chunks need a length above 0 and an overlap from 0 to below it")
    return float(chunk_s) - float(overlap_s)


def bounded(files: DataFrame, *, key: str = "path", total: str = "duration_s", chunk_s: float = 3.0, overlap_s: float = 0.0) -> DataFrame:
    """The columns of ``files`` with chunk_idx, start_s and end_s of each interval.

    Starts are 0, step, step + step and so on, added up one by one; the first
    interval that reaches the total is the last one and ends there.  A row whose
    total is null or not above 0 has no interval.  ``key`` must tell rows apart.

    Where sums of steps are exact, starts are products; otherwise they are looked
    up among the sums of so many steps, which are the same for all rows.  Nothing is
    shuffled.
    """
    step = _check(chunk_s, overlap_s)
    length = F.col(total).cast("double")
    last = F.greatest(F.lit(0), F.ceil((length - chunk_s) / step)).cast("long") + 1
    rows = files.where(length > 0).withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    if _dyadic(step):
        before, start = (F.col("chunk_idx") - 1) * F.lit(step), F.col("chunk_idx") * F.lit(step)
    else:
        rows = rows.withColumn("start_s", _added_up(step)(F.col("chunk_idx")))
        start = F.col("start_s")
        before = _added_up(step)(F.greatest(F.lit(0).cast("long"), F.col("chunk_idx") - 1))
    rows = rows.where((F.col("chunk_idx") == 0) | (before + F.lit(float(chunk_s)) < length))
    return rows.withColumns({"start_s": start, "end_s": F.least(start + F.lit(float(chunk_s)), length)})


def unbounded(rows: DataFrame, *, n: int, chunk_s: float, overlap_s: float = 0.0, start: Column | float = 0.0, key: str = "path") -> DataFrame:
    """The first ``n`` intervals from ``start`` on, whose ends are not clipped."""
    step = _check(chunk_s, overlap_s)
    first = start if isinstance(start, Column) else F.lit(float(start))
    rows = rows.withColumn("_first", first.cast("double")).withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    if _dyadic(step) and (not isinstance(start, Column)) and _dyadic(float(start)):
        at = F.col("_first") + F.col("chunk_idx") * F.lit(step)
    else:  # added up from the start on, one by one
        order = Window.partitionBy(key).orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, 0)
        at = F.sum(F.when(F.col("chunk_idx") == 0, F.col("_first")).otherwise(F.lit(step))).over(order)
    return rows.withColumn("start_s", at).withColumn("end_s", F.col("start_s") + F.lit(float(chunk_s))).drop("_first")


def frames(grid: DataFrame, rate: Column | int | str = "sample_rate") -> DataFrame:
    """Adds start_frame and end_frame, halves to the even frame."""
    rate = F.col(rate) if isinstance(rate, str) else rate if isinstance(rate, Column) else F.lit(rate)
    return grid.withColumns({"start_frame": frame_at(F.col("start_s"), rate), "end_frame": frame_at(F.col("end_s"), rate)})


def chunk_count(total: Column, chunk_s: float = 3.0, overlap_s: float = 0.0) -> Column:
    """Number of intervals, for a step whose sums are exact."""
    step = _check(chunk_s, overlap_s)
    if not _dyadic(step):
        raise ValueError("the number of intervals has no closed form for this overlap; count a bounded grid")
    return F.lit(1).cast("long") + F.greatest(F.lit(0).cast("long"), F.ceil((total - F.lit(float(chunk_s))) / F.lit(step)))


def slice_frames(samples: Column, start_frame: Column, end_frame: Column) -> Column:
    """Samples from start_frame to below end_frame."""
    return F.slice(samples, (start_frame + 1).cast("int"), (end_frame - start_frame).cast("int"))


def cut(samples: Column, position: Column, size: int) -> Column:
    """``size`` samples from ``position`` on, with zeros behind the last one."""
    part = F.slice(samples, (position + 1).cast("int"), F.lit(size))
    return padded(part, size)


def batches(rows: DataFrame, n: int, *, key: str = "path", index: str = "chunk_idx") -> DataFrame:
    """key, batch and the ordered indices of each run of up to ``n`` rows."""
    if n < 1:
        raise ValueError("a batch holds one row at least")
    batch = F.floor(F.col(index) / F.lit(n)).alias("batch")
    return rows.groupBy(key, batch).agg(F.array_sort(F.collect_list(index)).alias("members"))


def legacy(files: DataFrame, *, size: str = "n_samples", rate: int, chunk_s: float, overlap_s: float, least_s: float, key: str = "path") -> DataFrame:
    """Intervals of the older in-memory chunker: chunk_idx, position, start_s and
    end_s, with positions in samples.

    The last position is the nearest step to what is left after one chunk; it
    moves back by one step if fewer than ``least_s`` would remain, which can
    leave no interval.  Starts and ends ignore the recording's length.
    """
    chunk, step, least = round(chunk_s * rate), round((chunk_s - overlap_s) * rate), round(least_s * rate)
    n = F.col(size).cast("long")
    near = F.rint((n - F.lit(chunk) + F.lit(step) - 1) / F.lit(step)).cast("long") * F.lit(step)
    last = F.when(near < 0, F.lit(0).cast("long")).when(n - near < F.lit(least), near - F.lit(step)).otherwise(near)
    rows = files.withColumn("_last", last).where("_last >= 0")
    rows = rows.withColumn("position", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"), F.lit(step).cast("long")))).drop("_last")
    index = (F.col("position") / F.lit(step)).cast("long")
    hop = float(chunk_s) - float(overlap_s)
    if _dyadic(hop):
        start = index * F.lit(hop)
    else:
        start = F.coalesce(F.sum(F.lit(hop)).over(Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumns({"chunk_idx": index, "start_s": start, "end_s": start + F.lit(float(chunk_s))})
