"""Recordings as tables of intervals.

Files are read where Spark can read them (``binaryFile``).  WAV is decoded here;
other formats need the soundfile package on the workers.  A recording that can't
be used gives a row with an error and no samples.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid import schemas
from wavegrid.functions import dsp
from wavegrid.runtime import ship

#: Bytes at the start of a file in which a WAV header is looked for.
HEADER = 1 << 16


class Wav:
    """Header of a WAV file: PCM of 8 to 32 bits or IEEE floats."""

    def __init__(self, head: bytes, size: int):
        if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
            raise ValueError("not a WAV file")
        at, self.code = 12, None
        while at + 8 <= len(head):
            name, length = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
            if name == b"fmt ":
                self.code, self.channels, self.rate, _, self.frame, self.bits = struct.unpack_from("<HHIIHH", head, at + 8)
                if self.code == 0xFFFE:
                    self.code = struct.unpack_from("<H", head, at + 32)[0]
            elif name == b"data":
                if self.code not in (1, 3) or not self.frame:
                    raise ValueError("a WAV encoding that is not supported")
                self.start = at + 8
                self.frames = min(length, size - self.start) // self.frame
                return
            at += 8 + length + length % 2
        raise ValueError("a WAV file without samples")

    def read(self, data: bytes | memoryview, first: int, last: int) -> np.ndarray:
        """Samples of a range of frames as float32, a column per channel."""
        part = bytes(data[self.start + first * self.frame : self.start + min(last, self.frames) * self.frame])
        width = self.bits // 8
        if self.code == 3:
            values = np.frombuffer(part, f"<f{width}").astype(np.float32)
        elif width == 1:
            values = (np.frombuffer(part, np.uint8).astype(np.float32) - 128) / 128
        elif width == 3:
            raw = np.frombuffer(part, np.uint8).reshape(-1, 3).astype(np.int32)
            values = (((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) << 8 >> 8) / np.float32(1 << 23)).astype(np.float32)
        else:
            values = (np.frombuffer(part, f"<i{width}") / np.float64(1 << (self.bits - 1))).astype(np.float32)
        return values.reshape(-1, self.channels)


class Other:
    """Any format that the soundfile package reads."""

    def __init__(self, content: bytes):
        try:
            import soundfile
        except ImportError as error:
            raise ValueError("this format needs the soundfile package") from error
        self.file = soundfile.SoundFile(io.BytesIO(content))
        self.channels, self.rate, self.frames = self.file.channels, self.file.samplerate, len(self.file)

    def read(self, data, first: int, last: int) -> np.ndarray:
        self.file.seek(first)
        return self.file.read(last - first, dtype="float32", always_2d=True)


def open_audio(content: bytes):
    """A reader of one recording of one channel with at least one frame."""
    found = Wav(content[:HEADER], len(content)) if content[:4] in (b"RIFF", b"RF64") else Other(content)
    if found.channels != 1:
        raise ValueError(f"the recording has {found.channels} channels; only one is supported")
    if not found.frames:
        raise ValueError("the recording has no samples")
    return found


def intervals(total: float, chunk_s: float, overlap_s: float) -> Iterator[tuple[float, float]]:
    """The bounded grid of one recording, starts added up one by one."""
    step, start = float(chunk_s) - float(overlap_s), 0.0
    while start + chunk_s < total:
        yield start, start + float(chunk_s)
        start += step
    yield start, float(total)


def fitted(x: np.ndarray, size: int) -> np.ndarray:
    """Samples with silence up to ``size``, or cut there: rounding of a
    resampled length may give a few samples too many."""
    return np.pad(x, (0, size - len(x))) if len(x) <= size else x[:size]


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("sample_rate", pa.int32()), ("n_frames", pa.int64()), ("duration_s", pa.float64()), ("channels", pa.int32()), ("error", pa.string())])
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            row = {"path": path}
            try:
                found = open_audio(content or b"")
                row |= {"sample_rate": found.rate, "n_frames": found.frames, "duration_s": found.frames / found.rate, "channels": found.channels}
            except Exception as error:  # every fault of a file becomes its row's error
                row["error"] = str(error)
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema)


def files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content) of the recordings, read by Spark; paths that are given
    again are read once."""
    ship(spark)
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def probe(recordings: DataFrame) -> DataFrame:
    """Rate, frames, duration, channels or error per recording."""
    return recordings.select("path", "content").mapInArrow(_probe, schemas.AUDIO_FILE)


_CHUNK = pa.schema([("path", pa.string()), ("chunk_idx", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])


def read_chunks(content: bytes, chunk_s: float, overlap_s: float, rate: int) -> Iterator[tuple[float, float, np.ndarray]]:
    """(start, end, samples at ``rate``) of one recording's intervals."""
    found = open_audio(content)
    for start, end in intervals(found.frames / found.rate, chunk_s, overlap_s):
        part = found.read(content, round(start * found.rate), round(end * found.rate))[:, 0]
        yield start, end, dsp.resample(part, found.rate, rate)


def chunks(recordings: DataFrame, *, chunk_s: float = 3.0, overlap_s: float = 0.0, target_sample_rate: int = 48_000) -> DataFrame:
    """A row per interval with its samples, resampled to the target rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                path = path.as_py()
                try:
                    for i, (start, end, x) in enumerate(read_chunks(content.as_py() or b"", chunk_s, overlap_s, target_sample_rate)):
                        yield pa.RecordBatch.from_pylist([{"path": path, "chunk_idx": i, "start_s": start, "end_s": end, "samples": x}], _CHUNK)
                except Exception as error:
                    yield pa.RecordBatch.from_pylist([{"path": path, "error": str(error)}], _CHUNK)

    return recordings.select("path", "content").mapInArrow(run, schemas.CHUNK)


_SCORES = pa.schema([("path", pa.string()), ("chunk_idx", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("logits", pa.list_(pa.float32())), ("error", pa.string())])


def scores(recordings: DataFrame, scorer, *, overlap_s: float = 0.0, batch_size: int = 100, band: tuple[float, float] | None = None, wanted: list[int] | None = None) -> DataFrame:
    """A row per interval with its score vector.

    Decoding, resampling, padding, band filter and scoring are one pass, so
    samples never leave the function; at most ``batch_size`` chunks are held.
    ``wanted`` are the places of the scores that are kept.  A recording that
    fails late leaves one row with its error and none of its intervals.
    """
    size = round(scorer.sample_rate * scorer.chunk_size_s)

    def score(held: list[tuple[float, float, np.ndarray]]) -> np.ndarray:
        x = np.stack([fitted(c[2], size) for c in held]).astype(np.float32)
        if band is not None:
            x = dsp.filtered(x, scorer.sample_rate, *band, scorer.sig_fmin, scorer.sig_fmax)
            if not np.isfinite(x).all():
                raise ValueError("the band filter overflows")
        out = np.asarray(scorer.predict_species(x), np.float32)
        if out.shape != (len(held), len(scorer.species)):
            raise ValueError(f"the classifier returned {out.shape[1:]} scores for {len(scorer.species)} labels")
        return out if wanted is None else out[:, wanted]

    def one(path: str, content: bytes) -> Iterator[dict]:
        held, i = [], 0

        def flush():
            nonlocal i, held
            for (start, end, _), row in zip(held, score(held)):
                yield {"path": path, "chunk_idx": i, "start_s": start, "end_s": end, "logits": row}
                i += 1
            held = []

        for chunk in read_chunks(content, scorer.chunk_size_s, overlap_s, scorer.sample_rate):
            held.append(chunk)
            if len(held) == batch_size:
                yield from flush()
        if held:
            yield from flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                path = path.as_py()
                try:
                    rows = list(one(path, content.as_py() or b""))
                except Exception as error:
                    rows = [{"path": path, "error": str(error)}]
                for at in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 256], _SCORES)

    return recordings.select("path", "content").mapInArrow(run, schemas.SCORES)
