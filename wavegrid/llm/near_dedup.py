"""Near-duplicate grouping by SuperMinHash.

1. One pass over the texts gives each document its shingle count, a 128-bit
   digest of its word sequence and band keys.  The signature is SuperMinHash: an
   element's slots are the steps of one permutation per element, its value in
   step j is j plus a fraction, and a document stops at the first step from which
   no later value could be lower.
2. Documents of equal word sequence form a class at once; only classes go on.
3. Classes that share a band meet.  In each band a pivot (by a hash, so it
   differs between bands) is compared with every other member; a comparison
   counts the shingles of both whole texts.  Components come from union-find and
   star contraction.
4. Where a band of three or more still has several components, each member
   outside its main component is held against all others of the band.  The band
   is cut into tiles of at most ``BLOCK`` members by ``BLOCK`` outsiders (fewer
   where texts are long), and a tile's task verifies its pairs itself: it counts
   common shingles of the whole texts, keeps a union-find over the components it
   sees, and passes on only links that join two of them, so at most one for each
   row that it was given.  After that every two members of a band are compared or
   in one component.

Two documents of similarity s share one of the 32 bands of 5 values with
probability 1 - (1 - s**5)**32: 0.999997 at 0.8.

Hot keys: counts and pivots of bands are summed before their shuffle and stored,
so that the joins behind them stand alone in their stage and adaptive execution
can split a hot band, pivot or class there.

Words are runs of other than ASCII white space, A to Z lower-cased.  A text with
fewer words than a shingle is one shingle of all its words; a null or blank text
has none, and is its own group.  Rows that share an id and the text are in one
group; rows that share an id only are apart.  A null id counts last: a group's
id is its least id that is not null, and is null if there is none.  Ties: a
similarity of exactly ``percent`` / 100 links.  An empty table gives an empty
one.  Other columns are not read and can have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.llm.common import SPACE, fresh, materialize, mix, partitions, portions, ragged, text_key, utf8, word_hashes
from wavegrid.llm.components import UnionFind, components
from wavegrid.runtime import ship

BANDS, BAND_ROWS = 32, 5

#: Bytes of text described at once; members of a band that a tile holds, and the
#: shingles that they may have; outsiders compared at once.
PORTION, BLOCK, BLOCK_SHINGLES, ROUND = 1 << 20, 512, 1 << 21, 256

#: Members that a shingle needs for a column in a tile's table, and its cells.
DENSE, CELLS = 16, 1 << 24

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TO_LOWER = bytes(_LOWER)
_G1, _G2, _G3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def normal(text: bytes) -> bytes:
    """Words of a text, A to Z lower-cased, joined by one blank."""
    return b" ".join(text.translate(_TO_LOWER).split())


def shingle_set(words: bytes, k: int) -> set:
    """The shingles of a :func:`normal` text."""
    w = words.split(b" ") if words else []
    if not w:
        return set()
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else {tuple(w)}


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of the distinct shingles of texts, sorted."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = _LOWER[data]
    space = SPACE[data]
    after, before = np.append(space[1:], True), np.insert(space[:-1], 0, True)
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = word_hashes(data, starts, ends)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(doc, minlength=rows)
    first = np.cumsum(counts) - counts
    place = np.arange(len(h)) - first[doc]
    at = np.flatnonzero(place <= (counts[doc] - k))
    out = h[at]
    for j in range(1, k):
        out = mix(out * _G1 + h[at + j])
    short = np.flatnonzero((counts > 0) & (counts < k))
    whole = np.zeros(len(short), np.uint64)
    for x, d in enumerate(short):
        value = h[first[d] : first[d] + 1]
        for j in range(1, counts[d]):
            value = mix(value * _G1 + h[first[d] + j : first[d] + j + 1])
        whole[x] = value[0]
    docs, values = np.concatenate([doc[at], short]), np.concatenate([out, whole])
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    return docs[new], values[new]


def super_minhash(docs: np.ndarray, elements: np.ndarray, rows: int, size: int) -> np.ndarray:
    """SuperMinHash signatures, ``rows`` x ``size``; ``docs`` has the row of each
    element.  All elements take step j together; rows that are final leave."""
    out = np.full((rows, size), np.inf)
    flat = out.reshape(-1)
    live = np.zeros(rows, bool)
    live[docs] = True
    swaps: list[np.ndarray] = []  # of the elements still there, in each step so far
    slots: np.ndarray | None = None  # their permutations, once they are few
    for j in range(size):
        keep = live[docs]
        if not keep.all():
            docs, elements = docs[keep], elements[keep]
            swaps = [s[keep] for s in swaps]
            slots = None if slots is None else slots[keep]
        if not len(docs):
            break
        value = (mix(elements + np.uint64((j + 1) * int(_G1) % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        pick = (mix(elements ^ np.uint64((j + 1) * int(_G2) % 2**64)) % np.uint64(size - j)).astype(np.int64) + j
        if slots is None and j >= 4 and len(docs) * size <= 1 << 22:
            slots = np.tile(np.arange(size, dtype=np.int16), (len(docs), 1))
            every = np.arange(len(docs))
            for t, s in enumerate(swaps):
                slots[every, s], slots[:, t] = slots[:, t].copy(), slots[every, s].copy()
            swaps = []
        if slots is None:
            slot = pick.copy()
            for t in range(j - 1, -1, -1):
                s = swaps[t]
                hit = slot == s
                slot[hit] = t  # a place behind t that step t filled came from t
            swaps.append(pick)
        else:
            every = np.arange(len(docs))
            slot = slots[every, pick].astype(np.int64)
            slots[every, pick] = slots[:, j]
        np.minimum.at(flat, docs * size + slot, value + j)
        there = np.flatnonzero(live)
        live[there[out[there].max(axis=1) < j + 1]] = False
    return out


def bands_of(signatures: np.ndarray, bands: int, band_rows: int) -> np.ndarray:
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, band_rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _G3), bits.shape[:2]).copy()
    for j in range(band_rows):
        key = mix(key * _G1 + bits[:, :, j])
    return key.view(np.int64)


def _describe(k: int, bands: int, band_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for at, end in portions(offsets, PORTION):
                own = offsets[at : end + 1]
                part, rows = data[own[0] : own[-1]], end - at
                docs, values = shingles(part, own - own[0], k)
                signatures = super_minhash(docs, values, rows, bands * band_rows)
                keys = bands_of(signatures, bands, band_rows)
                n = np.bincount(docs, minlength=rows)
                raw = part.tobytes()
                digests = [hashlib.blake2b(normal(raw[a - own[0] : b - own[0]]), digest_size=16).digest() for a, b in zip(own[:-1], own[1:])]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)), pa.array(keys[n > 0].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, rows), batch.column(1).slice(at, rows), pa.array(digests, pa.binary()), pa.array(n.astype(np.int64)), lists],
                    names=["doc_id", "text_key", "key", "n", "bands"],
                )

    return run


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for at in range(0, batch.num_rows, 512):
            own = offsets[at : at + 513]
            words = [normal(data[a:b].tobytes()) for a, b in zip(own[:-1], own[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), pa.array([hashlib.blake2b(w, digest_size=16).digest() for w in words], pa.binary()), pa.array([pack.compress(w) for w in words], pa.binary())], names=["doc_id", "key", "words"])


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last: tuple = (None, None)
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            good = []
            for i in range(batch.num_rows):
                if a[i] != last[0]:
                    last = (a[i], shingle_set(unpack.decompress(batch.column(2)[i].as_py()), k))
                x, y = last[1], shingle_set(unpack.decompress(batch.column(3)[i].as_py()), k)
                both = len(x & y)
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


class _Tile:
    """The members of a band's part, and the components known so far."""

    def __init__(self, group, k: int, percent: int):
        self.group, self.k, self.percent = group, k, percent
        self.keys: list[bytes] = []
        self.words: list[bytes] = []
        self.labels: list[bytes] = []
        self.sets = UnionFind()
        self.ready = False

    def add(self, key: bytes, label: bytes, words: bytes) -> None:
        self.keys.append(key)
        self.labels.append(label)
        self.words.append(words)

    def _lay_out(self) -> None:
        """Shingles of the members by column: those of many members as a table,
        the others as lists of members."""
        doc, value = _hashed(self.words, self.k)
        rows = len(self.keys)
        self.columns, column, count = np.unique(value, return_inverse=True, return_counts=True)
        wide = np.flatnonzero(count >= DENSE)
        wide = wide[np.argsort(-count[wide], kind="stable")][: CELLS // max(rows, 1)]
        self.place = np.full(len(self.columns), -1)
        self.place[wide] = np.arange(len(wide))
        at = self.place[column]
        self.table = np.zeros((rows, len(wide)), np.float32)
        self.table[doc[at >= 0], at[at >= 0]] = 1
        thin = at < 0
        order = np.argsort(column[thin], kind="stable")
        self.thin = doc[thin][order]
        self.count = np.where(self.place < 0, count, 0)
        self.first = np.cumsum(self.count) - self.count
        self.sizes = np.bincount(doc, minlength=rows)
        self.ready = True

    def common(self, doc: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """Common shingles of each of ``rows`` texts and each member."""
        at = np.minimum(np.searchsorted(self.columns, value), max(len(self.columns) - 1, 0))
        known = self.columns[at] == value if len(self.columns) else np.zeros(len(value), bool)
        doc, at = doc[known], at[known]
        place = self.place[at]
        table = np.zeros((rows, self.table.shape[1]), np.float32)
        table[doc[place >= 0], place[place >= 0]] = 1
        out = np.rint(table @ self.table.T).astype(np.int64)
        doc, at = doc[place < 0], at[place < 0]
        member = self.thin[ragged(self.first[at], self.count[at])]
        cells = np.repeat(doc, self.count[at]) * len(self.keys) + member
        return out + np.bincount(cells, minlength=out.size).reshape(out.shape)

    def links(self, keys: list[bytes], labels: list[bytes], words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Links of these outsiders with members that join two components."""
        if not self.keys or not keys:
            return []
        if not self.ready:
            self._lay_out()
        doc, value = _hashed(words, self.k)
        both = self.common(doc, value, len(keys))
        sizes = np.bincount(doc, minlength=len(keys))
        close = 100 * both >= self.percent * (sizes[:, None] + self.sizes[None, :] - both)
        found = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(close))):
            if self.sets.find(labels[i]) != self.sets.find(self.labels[j]) and similar(words[i], self.words[j], self.k, self.percent):
                self.sets.union(labels[i], self.labels[j])
                found.append((min(keys[i], self.keys[j]), max(keys[i], self.keys[j])))
        return found


def similar(a: bytes, b: bytes, k: int, percent: int) -> bool:
    """Whether two :func:`normal` texts are linked, by their shingles themselves."""
    x, y = shingle_set(a, k), shingle_set(b, k)
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _hashed(words: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(words), np.uint8)
    return shingles(data, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64), k)


def _sweep(k: int, percent: int):
    """Links that join two components, of each (band, part, side): the members of
    ``part`` come first, then the outsiders of ``side``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        tile, waiting = None, ([], [], [])

        def done() -> pa.RecordBatch:
            found = tile.links(*waiting) if tile else []
            for x in waiting:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], names=["a", "b"])

        held = 0
        for r in (r for batch in batches for at in range(0, batch.num_rows, ROUND) for r in batch.slice(at, ROUND).to_pylist()):
            group = r["band"], r["part"], r["side"]
            if tile is None or group != tile.group:
                yield done()
                tile, held = _Tile(group, k, percent), 0
            words = unpack.decompress(r["words"])
            if r["kind"] == 0:
                tile.add(r["key"], r["label"], words)
                continue
            for x, y in zip(waiting, (r["key"], r["label"], words)):
                x.append(y)
            held += len(words)
            if len(waiting[0]) >= ROUND or held >= PORTION:
                yield done()
                held = 0
        yield done()

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_key (which tells apart rows
    that share an id) per row.

    Rows are linked from a Jaccard similarity of ``percent`` / 100 of their sets
    of ``k``-word shingles on; ``kept`` marks the rows whose id is their
    group's.
    """
    ship(docs.sparkSession)
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    described = materialize(keyed.mapInArrow(_describe(k, bands, band_rows), "doc_id bigint, text_key bigint, key binary, n bigint, bands array<bigint>"), "described")
    classes = described.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")

    met = classes.select(F.explode("bands").alias("band"), "key", "n")
    shared = met.groupBy("band").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.min(F.struct(F.xxhash64("key", "band").alias("h"), "key", "n")).alias("pivot")).where("size > 1")
    shared = materialize(shared, "shared-bands")
    met = materialize(met.join(shared, "band"), "met")
    pairs = met.where((F.col("key") != F.col("pivot.key")) & (100 * F.least("n", "pivot.n") >= percent * F.greatest("n", "pivot.n")))
    pairs = materialize(pairs.select(F.least("key", "pivot.key").alias("a"), F.greatest("key", "pivot.key").alias("b")).distinct(), "pairs")

    wanted = materialize(met.select("key").distinct(), "wanted-keys").join(classes.select("key", "rep"), "key")
    texts = rows.mapInArrow(_payload, "doc_id bigint, key binary, words binary").withColumnRenamed("key", "own")
    held = wanted.join(texts, F.col("key").eqNullSafe(F.col("own")) & F.col("rep").eqNullSafe(F.col("doc_id"))).dropDuplicates(["key", "rep"]).select("key", "words")
    held = materialize(held, "texts")
    both = pairs.join(held.select(F.col("key").alias("b"), F.col("words").alias("wb")), "b").join(held.select(F.col("key").alias("a"), F.col("words").alias("wa")), "a")
    links = materialize(both.select("a", "b", "wa", "wb").mapInArrow(_confirm(k, percent), "a binary, b binary"), "links")
    labels = components(links)

    wide = met.where("size > 2").select("band", "key", "size", "total").join(labels.withColumnRenamed("node", "key"), "key", "left")
    wide = materialize(wide.withColumn("label", F.coalesce("label", "key")), "members")
    per_label = wide.groupBy("band", "label").agg(F.count("*").alias("c"))
    main = per_label.groupBy("band").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("most"), F.count("*").alias("labels")).where("labels > 1").select("band", "main", "most")
    main = materialize(main, "open-bands")

    def tiles(rows, total):
        """Parts that so many rows, of so many shingles, are cut into."""
        return F.greatest(F.lit(1), F.ceil(rows / F.lit(BLOCK)), F.ceil(total / F.lit(BLOCK_SHINGLES))).cast("int")

    outside = F.col("size") - F.col("most")
    open_ = wide.join(main, "band").select("band", "key", "label", (F.col("label") != F.col("main")).alias("out"), tiles(F.col("size"), F.col("total")).alias("parts"), tiles(outside, F.col("total") * outside / F.col("size")).alias("sides"))
    open_ = materialize(open_.join(held, "key"), "open-members")
    part, side = F.pmod(F.xxhash64("key"), "parts").cast("int"), F.pmod(F.xxhash64("key"), "sides").cast("int")
    block = open_.select("band", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"), F.lit(0).alias("kind"), "key", "label", "words")
    outer = open_.where("out").select("band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), side.alias("side"), F.lit(1).alias("kind"), "key", "label", "words")
    swept = block.unionByName(outer).repartition(n, "band", "part", "side").sortWithinPartitions("band", "part", "side", "kind")
    more = materialize(swept.mapInArrow(_sweep(k, percent), "a binary, b binary").distinct(), "more-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    linked = labels.withColumnRenamed("node", "key").join(classes.select("key", "rep"), "key")
    least = materialize(linked.groupBy("label").agg(F.min("rep").alias("component_id")), "groups")
    named = classes.select("key", "rep").join(linked.join(least, "label").select("key", "component_id"), "key", "left")
    named = materialize(named.select("key", F.coalesce("component_id", "rep").alias("component_id")), "named")
    out = described.select("doc_id", "text_key", "key", "n").join(named, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_key")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all their columns.

    Of rows that repeat a kept id, one stays; rows without an id stay unless
    their group has an id.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, k=k, percent=percent).select("doc_id", "text_key", "kept")
    found = materialize(found, "kept")
    verdict = found.where("not kept").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    same = docs[id_col].eqNullSafe(verdict["_doc"]) & (text_key(docs[text_col]) == verdict["_key"])
    out = docs.join(verdict, same, "left_anti")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not repeated.isEmpty():
        nth, rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))), fresh(docs, "nth")
        out = out.where(F.col(id_col).isNotNull()).withColumn(rank, nth).where(F.col(rank) == 1).drop(rank).unionByName(out.where(F.col(id_col).isNull()))
    return out
