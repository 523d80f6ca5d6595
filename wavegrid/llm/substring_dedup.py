"""Exact removal of repeated passages by super-k-mer partitioning.

A window is ``size`` consecutive words of one document; a window repeats if the
same words also start earlier, in a document of a smaller id or earlier in the
same one.  Every word that a repeating window covers is removed.

1. A window's minimiser is the least hash of its ``SEED`` word runs.  A run of
   consecutive windows with one minimiser is a super-k-mer, and travels as one
   packed string to the minimiser's bucket; the strings that one task has for a
   bucket are compressed together.
2. A bucket hashes its windows, sorts the hashes and compares the words of equal
   ones; all but the first by (id, start) repeat.  Equal windows have the same
   minimiser, so no window is missed.
3. The covered ranges meet their document's text by the document's key, and the
   kept words are joined by one blank.

A minimiser that many super-k-mers share would overfill its bucket.  Such
minimisers are found beforehand in a sixteenth of the documents; their windows
travel one by one to the bucket of their own words, and equal ones of a task are
reduced to the first (the others are already known to repeat).  This changes
only the way that windows take.

Cases: a null or blank text has no words, keeps none and its result is an empty
text; a text shorter than a window is kept; rows of one id count as one document
(equal rows get equal results, and of two texts of one id the earlier start
counts); a null id counts as larger than any other; of equal windows the one of the
smallest id and start stays; an empty table gives an empty one; other columns are
not read and can have any names.

A bucket is held by one task: of B bytes of text and p shuffle partitions it has
about 3.4 B / 4p compressed bytes, so p should grow with B (1 GB of text for each
partition or less keeps a bucket below 1 GB unpacked).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.common import materialize, mix, partitions, portions, ragged, run_hashes, text_key, utf8, word_hashes
from wavegrid.runtime import ship

SIZE, SEED = 20, 3

#: Bytes of text packed at once, buckets per shuffle partition.
PORTION, BUCKETS = 1 << 22, 4

#: One document in SAMPLE is looked at for hot minimisers; a minimiser is hot
#: from HOT sampled super-k-mers on, and from the 2**-18 part of all of them.
SAMPLE, HOT, HOT_SHARE = 16, 64, 1 << 18

_NO_ID = np.iinfo(np.int64).max


class Words:
    """Words of some texts, in one buffer: each text's words joined by one
    blank, a line feed after each text."""

    def __init__(self, texts: list[bytes]):
        joined = [b" ".join(t.split()) for t in texts]
        self.counts = np.array([t.count(b" ") + 1 if t else 0 for t in joined], np.int64)
        self.raw = b"\n".join([t for t in joined if t]) + b"\n"
        self.data = np.frombuffer(self.raw, np.uint8)
        self.ends = np.flatnonzero((self.data == 32) | (self.data == 10)) if self.counts.any() else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]).astype(np.int64) if len(self.ends) else self.ends
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.first = np.cumsum(self.counts) - self.counts
        self.text = np.repeat(np.arange(len(texts)), self.counts)

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows."""
        last = np.repeat(self.first + self.counts - size, self.counts)
        return np.flatnonzero(np.arange(len(last)) <= last)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    low, have = values, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def super_kmers(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, minimiser) of each super-k-mer."""
    at = words.windows(size)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    seed = min(SEED, size)
    least = sliding_min(run_hashes(words.hashes, seed), size - seed + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (words.text[at[1:]] != words.text[at[:-1]])
    begin = np.flatnonzero(new)
    return at[begin], np.diff(np.append(begin, len(at))), least[begin]


def _minimisers(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in portions(offsets, PORTION):
                words = Words([data[x:y].tobytes() for x, y in zip(offsets[a:b], offsets[a + 1 : b + 1])])
                yield pa.RecordBatch.from_arrays([pa.array(super_kmers(words, size)[2].view(np.int64))], names=["key"])

    return run


def _blob(doc, key, start, count, sizes, body: bytes, ranges: tuple | None, pack) -> bytes:
    """One bucket's share of a portion.  ``ranges`` are rows of repeats that are
    already known: ids, text keys, starts, counts."""
    none = np.zeros(0, np.int64)
    rows = ranges or (none, none, none, none)
    head = np.array([len(doc), len(rows[0])], np.int64)
    parts = [head, doc, key, start.astype(np.int64), count.astype(np.int64), sizes.astype(np.int64), *rows]
    return pack.compress(b"".join(p.astype(np.int64).tobytes() for p in parts) + body)


def _open(blob: bytes, unpack) -> tuple[list[np.ndarray], list[np.ndarray], bytes]:
    raw = unpack.decompress(blob)
    n, m = np.frombuffer(raw, np.int64, 2)
    fields, at = [], 16
    for size in (n, n, n, n, n, m, m, m, m):
        fields.append(np.frombuffer(raw, np.int64, size, at))
        at += 8 * int(size)
    return fields[:5], fields[5:], raw[at:]


def merged(doc, key, start, count) -> tuple[np.ndarray, ...]:
    """Ranges of words with neighbours and repeats of one text joined."""
    if not len(doc):
        return doc, key, start, count
    order = np.lexsort((start, key, doc))
    doc, key, start, stop = doc[order], key[order], start[order], (start + count)[order]
    new = np.ones(len(doc), bool)
    other = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    # Ranges of a text are sorted; the running end is a maximum within the text.
    text = np.cumsum(np.concatenate([[0], other]))
    span = int(stop.max()) + 1
    reach = np.maximum.accumulate(text * span + stop) - text * span
    new[1:] = other | (start[1:] > reach[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(doc)) - 1
    return doc[begin], key[begin], start[begin], reach[last] - start[begin]


def _pack(size: int, hot: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(_NO_ID), dtype=np.int64)
            keys = np.asarray(batch.column(1), dtype=np.int64)
            data, offsets = utf8(batch.column(2))
            for a, b in portions(offsets, PORTION):
                words = Words([data[x:y].tobytes() for x, y in zip(offsets[a:b], offsets[a + 1 : b + 1])])
                yield _packed(words, ids[a:b], keys[a:b], size, hot, buckets, pack)

    return run


def _packed(words: Words, ids, keys, size, hot, buckets, pack) -> pa.RecordBatch:
    at, count, least = super_kmers(words, size)
    known = None
    where = mix(least) % np.uint64(buckets)
    if len(hot) and len(at):
        near = np.minimum(np.searchsorted(hot, least), len(hot) - 1)
        is_hot = hot[near] == least
        if is_hot.any():
            single = ragged(at[is_hot], count[is_hot])
            value = run_hashes(words.hashes, size)[single]
            single, value, known = _reduced(words, ids, keys, size, single, value)
            at = np.concatenate([at[~is_hot], single])
            count = np.concatenate([count[~is_hot], np.ones(len(single), np.int64)])
            where = np.concatenate([where[~is_hot], mix(value) % np.uint64(buckets)])
    order = np.argsort(where, kind="stable")
    at, count, where = at[order], count[order], where[order].astype(np.int64)
    text = words.text[at]
    begin, sizes = words.starts[at], words.ends[at + count + size - 2] - words.starts[at] + 1
    body = words.data[ragged(begin, sizes)]
    # The byte behind a string is a blank or a line feed; in a bucket it ends the string.
    body[np.cumsum(sizes) - 1] = 10
    body = body.tobytes()
    names, first = np.unique(where, return_index=True)
    bounds, bytes_at = np.append(first, len(where)), np.concatenate([[0], np.cumsum(sizes)])
    out_bucket, out_blob = [], []
    for x, name in enumerate(names):
        s = slice(bounds[x], bounds[x + 1])
        blob = _blob(ids[text[s]], keys[text[s]], at[s] - words.first[text[s]], count[s], sizes[s], body[bytes_at[s.start] : bytes_at[s.stop]], known if x == 0 else None, pack)
        out_bucket.append(int(name))
        out_blob.append(blob)
    return pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(out_blob, pa.binary())], names=["bucket", "blob"])


def _repeats(raw: bytes, begin, stop, value, doc, start) -> np.ndarray:
    """Which windows repeat an earlier one of the same words.  Windows of equal
    hash are compared by their bytes."""
    flagged = np.zeros(len(value), bool)
    order = np.argsort(value, kind="stable")
    v = value[order]
    same = np.zeros(len(v), bool)
    same[1:] = v[1:] == v[:-1]
    member = same | np.append(same[1:], False)
    group = order[member]
    if not len(group):
        return flagged
    group = group[np.lexsort((start[group], doc[group], value[group]))]
    lead = np.ones(len(group), bool)
    lead[1:] = value[group][1:] != value[group][:-1]
    head = group[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
    later = (doc[group] != doc[head]) | (start[group] != start[head])
    x, y = group[later], head[later]
    equal = np.fromiter((raw[a:b] == raw[c:d] for a, b, c, d in zip(begin[x].tolist(), stop[x].tolist(), begin[y].tolist(), stop[y].tolist())), bool, len(x))
    flagged[x[equal]] = True
    for h in np.unique(value[x[~equal]]):  # different words of one hash: by the words themselves
        least: dict[bytes, tuple] = {}
        rows = group[value[group] == h]
        for r in rows:
            words = raw[begin[r] : stop[r]]
            least[words] = min(least.get(words, (doc[r], start[r])), (doc[r], start[r]))
        for r in rows:
            flagged[r] = (doc[r], start[r]) > least[raw[begin[r] : stop[r]]]
    return flagged


def _reduced(words: Words, ids, keys, size, single, value):
    """Of equal windows of a portion the first; the others as known ranges."""
    text = words.text[single]
    start = single - words.first[text]
    flagged = _repeats(words.raw, words.starts[single], words.ends[single + size - 1], value, ids[text], start)
    known = merged(ids[text[flagged]], keys[text[flagged]], start[flagged], np.full(int(flagged.sum()), size, np.int64))
    return single[~flagged], value[~flagged], known


def _count(size: int):
    """Ranges of repeating words of each bucket; a partition is sorted by bucket."""

    def solve(blobs, unpack) -> pa.RecordBatch:
        opened = [_open(b, unpack) for b in blobs]
        doc, key, start, count, sizes = (np.concatenate([o[0][j] for o in opened]) for j in range(5))
        raw = b"".join(o[2] for o in opened)
        ranges = [np.concatenate([o[1][j] for o in opened]) for j in range(4)]
        if len(doc):
            data = np.frombuffer(raw, np.uint8)
            ends = np.flatnonzero((data == 32) | (data == 10))
            starts = np.concatenate([[0], ends[:-1] + 1])
            first = np.cumsum(count + size - 1) - (count + size - 1)  # of a string, among all words
            at = ragged(first, count)
            value = run_hashes(word_hashes(data, starts, ends), size)[at]
            row = np.repeat(np.arange(len(doc)), count)
            place = start[row] + at - first[row]
            flagged = _repeats(raw, starts[at], ends[at + size - 1], value, doc[row], place)
            row, place = row[flagged], place[flagged]
            ranges = [np.concatenate(x) for x in zip(ranges, (doc[row], key[row], place, np.full(len(row), size, np.int64)))]
        doc, key, start, count = merged(*ranges)
        return pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == _NO_ID), pa.array(key), pa.array(start), pa.array(count)], names=["doc_id", "text_key", "start", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        bucket, blobs = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                if name != bucket:
                    if blobs:
                        yield solve(blobs, unpack)
                    bucket, blobs = name, []
                blobs.append(batch.column(1)[i].as_py())
        if blobs:
            yield solve(blobs, unpack)

    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for a in range(0, batch.num_rows, 512):
            own = offsets[a : a + 513]
            texts = [pack.compress(data[x:y].tobytes()) for x, y in zip(own[:-1], own[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 512), batch.column(1).slice(a, 512), pa.array(texts, pa.binary())], names=["doc_id", "text_key", "text"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text, its ranges and then the text itself (each time it occurs)."""
    unpack = zstandard.ZstdDecompressor()
    owner, ranges = None, []
    for batch in batches:
        ids, n_words, n_removed, kept = [], [], [], []
        doc, key, start, count, text = (batch.column(name) for name in ("doc_id", "text_key", "start", "count", "text"))
        for i in range(batch.num_rows):
            name = (doc[i].as_py(), key[i].as_py())
            if name != owner:
                owner, ranges = name, []
            if not text[i].is_valid:
                ranges.append((start[i].as_py(), count[i].as_py()))
                continue
            words = unpack.decompress(text[i].as_py()).split()
            left, at = [], 0
            for a, n in sorted(ranges):
                left += words[at:a]
                at = max(at, a + n)
            left += words[at:]
            ids.append(name[0])
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
            if sum(map(len, kept[-64:])) > 1 << 22 or len(kept) >= 1024:
                yield _result(ids, n_words, n_removed, kept)
                ids, n_words, n_removed, kept = [], [], [], []
        yield _result(ids, n_words, n_removed, kept)


def _result(ids, n_words, n_removed, kept) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def hot_minimisers(rows: DataFrame, size: int) -> np.ndarray:
    """Sorted; at most ``HOT_SHARE`` of them."""
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SAMPLE)) == 0).select("text")
    counts = materialize(sample.mapInArrow(_minimisers(size), "key bigint").groupBy("key").agg(F.count("*").alias("n")), "minimisers")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") >= max(HOT, -(-total // HOT_SHARE))).select("key").toArrow().column(0)
    return np.sort(np.asarray(hot.combine_chunks(), dtype=np.int64).view(np.uint64)) if len(hot) else np.zeros(0, np.uint64)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the text that is left) per row."""
    ship(docs.sparkSession)
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    hot = hot_minimisers(rows, size)
    packed = rows.mapInArrow(_pack(size, hot, n * BUCKETS), "bucket int, blob binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    ranges = packed.mapInArrow(_count(size), "doc_id bigint, text_key bigint, start bigint, count bigint").withColumn("text", F.lit(None).cast("binary"))
    texts = rows.mapInArrow(_squeeze, "doc_id bigint, text_key bigint, text binary").select("doc_id", "text_key", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("count"), "text")
    met = ranges.unionByName(texts).repartition(n, "doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", F.col("text").isNotNull())
    return met.mapInArrow(_remove, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
