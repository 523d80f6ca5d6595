"""SentencePiece encoding and decoding by a max-plus scan.

An encoding is the cut of a text into vocabulary pieces with the largest sum of
piece scores, the scores being those of the public model file; a blank stands
for the word mark, one blank is put in front, and a character that is no piece
becomes its UTF-8 bytes (or, in a vocabulary without bytes, the unknown piece,
once for a run of such characters).  With bytes, decoding restores the text
exactly.  Scores are whole numbers of 2**-24, or of 1 where the file has whole
scores only, so that sums do not depend on their order.

Every text is split into chunks of ``chunk`` characters at any place; one that
fits in a chunk is cut at once, and the chunks of the others are spread over
tasks:

1. each chunk yields a transfer matrix: the best score from a path that enters
   it ``a`` characters after its start to one that leaves it ``b`` characters
   after its end (``a``, ``b`` below the longest piece's length);
2. the matrices are combined by the associative max-plus product: ``SPAN``
   neighbours at a time by a tree, then over a text's spans, then within each
   span, which gives the best score of every boundary state in front of every
   chunk; no task holds more than a span's matrices or a text's products;
3. with these scores each chunk finds, for every leaving state, the entering
   state on the best path; composing these maps from the end, likewise by spans,
   fixes the states;
4. each chunk is traced back on its own between its two states.

Spans are spread over tasks in steps 2 to 4, and each is read as a stream.

Where no piece has a word mark after another character, a line feed or a letter
beside another sign, a text falls into units whose best cuts are independent.
Units are then cut once and kept in a bounded cache per worker, and only the
ends of a chunk depend on its states; what lies between its first and its last
border of units is cut in step 1.  Any other vocabulary is scanned character by
character.

Among cuts of equal score, at each place the longest last piece wins, in one
pass and in chunks alike.

Cases: a null text has null ids, an empty one none; rows are independent, so
null and repeated ids and repeated rows each give a row; an empty table gives an
empty one; a word mark character in a text becomes bytes and comes back as
itself; other columns are not read, and may have any names.
"""

from __future__ import annotations

import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavegrid.llm.common import materialize, partitions
from wavegrid.runtime import ship

#: Characters of a chunk, chunks of a span, units in a cache.
CHUNK, SPAN, CACHE = 1 << 14, 64, 150_000

_MARK = "▁"
#: Blanks and the letters behind them, or the other characters behind them.
_UNIT = re.compile(r" *[^\W\d_¹²³]+|\n| *(?:[^\w \n]|[\d_¹²³])+| +")
#: Borders of units that are seen from both characters beside them.
_BORDER = re.compile(r"(?<=[^ ]) |(?<=\n)|(?<=[^\n])\n")
_LOW = -(1 << 60)


class Vocabulary:
    """Pieces and whole-number scores of a model file."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int], unknown: int = 0):
        raw = {i: bytes([int(p[3:5], 16)]) for i, p in enumerate(pieces) if re.fullmatch(r"<0x[0-9A-F]{2}>", p)}
        self.byte_ids = {b[0]: i for i, b in raw.items()}
        if 0 < len(self.byte_ids) < 256:
            raise ValueError("the vocabulary has no piece for some byte")
        self.unknown_id = unknown
        self.ids = {p.replace(_MARK, " "): i for i, p in enumerate(pieces) if i not in special and i not in raw}
        self.scale = 1 if all(float(scores[i]).is_integer() for i in self.ids.values()) else 1 << 24
        self.score = {p: round(scores[i] * self.scale) for p, i in self.ids.items()}
        self.unknown = min(self.score.values()) - 10 * self.scale
        self.longest = max(map(len, self.ids))
        #: By first character: [the same by the next one, score of the piece that
        #: ends here or None].
        self.tree: dict = {}
        for piece, score in self.score.items():
            level = self.tree
            for c in piece[:-1]:
                level = level.setdefault(c, [{}, None])[0]
            level.setdefault(piece[-1], [{}, None])[1] = score
        self.text = [raw[i] if i in raw else b"" if i in special else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        #: Of a character's bytes the first has the score.
        self.by_id = np.zeros(len(pieces), np.int64)
        self.by_id[list(self.ids.values())] = list(self.score.values())
        for byte, i in self.byte_ids.items():
            self.by_id[i] = 0 if 0x80 <= byte < 0xC0 else self.unknown
        if not self.byte_ids:
            self.by_id[unknown] = self.unknown
            self.text[unknown] = " \u2047 ".encode()
        #: Whether texts fall into units.
        self.units = all(map(_UNIT.fullmatch, self.ids))

    def steps(self, text: str, start: int) -> list[tuple[int, int]]:
        """(length, score) of the pieces at ``start``; a character that is none
        counts as one step."""
        found = []
        for n in range(1, min(self.longest, len(text) - start) + 1):
            score = self.score.get(text[start : start + n])
            if score is not None:
                found.append((n, score))
            elif n == 1:
                found.append((1, self.unknown))
        return found

    def name(self, piece: str) -> tuple[int, ...]:
        at = self.ids.get(piece)
        if at is not None:
            return (at,)
        return tuple(self.byte_ids[b] for b in piece.encode()) if self.byte_ids else (self.unknown_id,)

    def walk(self, text: str, entry: dict[int, int], limit: int) -> tuple[dict[int, int], dict[int, int]]:
        """Best score of every place reached by pieces that start before
        ``limit``, and the place where its last piece starts (-1: entered)."""
        best, back = dict(entry), dict.fromkeys(entry, -1)
        score = self.score
        for end in range(1, len(text) + 1):
            here, since = best.get(end, _LOW), back.get(end)
            for n in range(min(self.longest, end), 0, -1):
                before = best.get(end - n)
                if before is None or end - n >= limit:
                    continue
                s = score.get(text[end - n : end])
                if s is None:
                    if n > 1:
                        continue
                    s = self.unknown
                if before + s > here:
                    here, since = before + s, end - n
            if since is not None:
                best[end], back[end] = here, since
        return best, back

    def encode_unit(self, unit: str) -> bytes:
        """Ids of the best cut of one unit; from each start the tree of pieces is
        followed as far as the unit goes along."""
        size, tree, unknown, ids = len(unit), self.tree, self.unknown, self.ids
        best, back = [_LOW] * (size + 1), [0] * (size + 1)
        best[0] = 0
        for start in range(size):
            here, end = best[start], start + 1
            node = tree.get(unit[start])
            if (node is None or node[1] is None) and here + unknown > best[end]:
                best[end], back[end] = here + unknown, start
            while node is not None:
                score = node[1]
                if score is not None and here + score > best[end]:
                    best[end] = here + score
                    back[end] = start
                if end == size:
                    break
                node = node[0].get(unit[end])
                end += 1
        found, at = [], size
        while at:
            piece = unit[back[at] : at]
            one = ids.get(piece)
            if one is not None:
                found.append(one)
            else:
                found += self.name(piece)[::-1]
            at = back[at]
        found.reverse()
        return struct.pack(f"<{len(found)}i", *found)

    # Chunks.  ``text`` is the chunk and what follows it, up to the longest
    # piece's length less one; ``size`` is the chunk's length.

    def borders(self, text: str, size: int) -> tuple[int, int] | None:
        """First border of units behind all entering states, and last in the
        chunk."""
        if not self.units:
            return None
        places = [m.start() for m in _BORDER.finditer(text, 0, size) if m.start() >= self.longest]
        return (places[0], places[-1]) if places else None

    def transfer(self, head: str, head_size: int, middle: int | None = None, tail: str = "", tail_size: int = 0) -> np.ndarray:
        """Best score from each entering to each leaving state, ``_LOW`` if none.
        Without a ``middle`` (the score between the borders) the head is the
        whole chunk."""
        states = self.longest
        first = self._spread(head, head_size)
        if middle is None:
            return first
        out = np.full((states, states), _LOW, np.int64)
        ends, _ = self.walk(tail, {0: 0}, tail_size)
        for leave in range(states):
            if (s := ends.get(tail_size + leave)) is not None:
                out[:, leave] = np.where(first[:, 0] > _LOW, first[:, 0] + middle + s, _LOW)
        return out

    def _spread(self, text: str, size: int) -> np.ndarray:
        states = self.longest
        ahead = np.full((states, size + states), _LOW, np.int64)
        for a in range(states):
            ahead[a, a] = 0
        for p in range(size):
            row = ahead[:, p]
            open_ = row > _LOW
            if not open_.any():
                continue
            for n, s in self.steps(text, p):
                ahead[:, p + n] = np.where(open_, np.maximum(ahead[:, p + n], row + s), ahead[:, p + n])
        return ahead[:, size : size + states].copy()

    def _entered(self, entry: np.ndarray) -> dict[int, int]:
        return {a: int(v) for a, v in enumerate(entry) if v > _LOW}

    def entering(self, entry: np.ndarray, head: str, head_size: int, tail: str | None, tail_size: int) -> np.ndarray:
        """For each leaving state, the entering state on its best path, or -1."""
        out = np.full(self.longest, -1, np.int16)
        _, back = self.walk(head, self._entered(entry), head_size)
        if tail is None:
            for leave in range(self.longest):
                out[leave] = self._root(back, head_size + leave)
            return out
        ends, _ = self.walk(tail, {0: 0}, tail_size)
        root = self._root(back, head_size)
        for leave in range(self.longest):
            if tail_size + leave in ends:
                out[leave] = root
        return out

    @staticmethod
    def _root(back: dict[int, int], at: int) -> int:
        if at not in back:
            return -1
        while back[at] >= 0:
            at = back[at]
        return at

    def trace(self, entry: np.ndarray, leave: int, head: str, head_size: int, tail: str | None, tail_size: int) -> tuple[list[int], list[int]]:
        """Ids of the pieces that start in the head and in the tail, on the path
        that leaves the chunk in state ``leave``."""
        if tail is None:
            return self._ids(head, self._entered(entry), head_size, head_size + leave), []
        return self._ids(head, self._entered(entry), head_size, head_size), self._ids(tail, {0: 0}, tail_size, tail_size + leave)

    def _ids(self, text: str, entry: dict[int, int], limit: int, at: int) -> list[int]:
        _, back = self.walk(text, entry, limit)
        names: list[str] = []
        while back[at] >= 0:
            names.append(text[back[at] : at])
            at = back[at]
        return [i for p in reversed(names) for i in self.name(p)]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product, which is associative."""
    out = (a[:, :, None] + b[None, :, :]).max(axis=1)
    return np.where(out < _LOW // 2, _LOW, out)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Product of all, by a tree of pairs."""
    while len(matrices) > 1:
        pairs = [combine(a, b) for a, b in zip(matrices[::2], matrices[1::2])]
        matrices = pairs + matrices[len(pairs) * 2 :]
    return matrices[0]


def after(scores: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The state scores behind a matrix, from those in front of it."""
    return combine(scores[None, :], m)[0]


def merge_unknown(ids: np.ndarray, unknown: int) -> np.ndarray:
    """``ids`` with one unknown piece for each run of them."""
    again = np.zeros(len(ids), bool)
    again[1:] = (ids[1:] == unknown) & (ids[:-1] == unknown)
    return ids[~again]


class Cache(dict):
    """Ids of units as bytes, in two generations: when the young one is full it
    becomes the old one, from which units still in use come back."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit) or self.vocabulary.encode_unit(unit)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        if len(unit) <= 64:
            self[unit] = ids
        return ids

    def middle(self, text: str) -> bytes:
        """Ids of a text that is made of whole units (or of any, where texts do
        not fall into units), without regard to runs of unknown characters."""
        return b"".join(map(self.__getitem__, _UNIT.findall(text))) if self.vocabulary.units else self.vocabulary.encode_unit(text)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        ids = self.middle(" " + text)
        if self.vocabulary.byte_ids:
            return ids
        return merge_unknown(np.frombuffer(ids, np.int32), self.vocabulary.unknown_id).tobytes()


_caches: dict[str, Cache] = {}


def cache_of(model_path: str) -> Cache:
    """The worker's cache of a model file."""
    if model_path not in _caches:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = range(model.get_piece_size())
        _caches[model_path] = Cache(Vocabulary([model.id_to_piece(i) for i in size], [model.get_score(i) for i in size], {i for i in size if model.is_unknown(i) or model.is_control(i) or model.is_unused(i)}, model.unk_id()))
    return _caches[model_path]


def _lists(parts: list[bytes | None]) -> pa.Array:
    sizes = np.array([0 if p is None else len(p) // 4 for p in parts], np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([p is None for p in parts] + [False]))
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(p for p in parts if p), np.int32)))


def _encode(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_of(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [None if (t := x.as_py()) is None else cache.encode(t) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(ids)], names=["doc_id", "text", "ids"])

    return run


def _split(chunk: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = " " + batch.column(1)[i].as_py()
                starts = range(0, len(text), chunk)
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([text[s : s + chunk + longest - 1] for s in starts], pa.string()), pa.array([min(chunk, len(text) - s) for s in starts], pa.int32())],
                    names=["row", "k", "chunk", "size"],
                )

    return run


_PREPARED = "row bigint, k int, head string, head_size int, tail string, tail_size int, middle array<int>, matrix binary"


def _prepare(model_path: str):
    """Step 1: a chunk's ends, the ids between its borders, its matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_of(model_path)
        vocabulary = cache.vocabulary
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, rows = batch.slice(at, 64), []
                for r in part.to_pylist():
                    text, size = r["chunk"], r["size"]
                    if between := vocabulary.borders(text, size):
                        first, last = between
                        middle = cache.middle(text[first:last])
                        inner = int(vocabulary.by_id[np.frombuffer(middle, np.int32)].sum())
                        rows.append((text[:first], first, text[last:], size - last, middle, vocabulary.transfer(text[:first], first, inner, text[last:], size - last)))
                    else:
                        rows.append((text, size, None, 0, b"", vocabulary.transfer(text, size)))
                head, head_size, tail, tail_size, middle, matrix = zip(*rows)
                arrays = [part.column("row"), part.column("k"), pa.array(head, pa.string()), pa.array(head_size, pa.int32()), pa.array(tail, pa.string()), pa.array(tail_size, pa.int32()), _lists(list(middle)), pa.array([m.tobytes() for m in matrix], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "k", "head", "head_size", "tail", "tail_size", "middle", "matrix"])

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    return (r for batch in batches for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist())


def _batches(made: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Tuples as batches of some rows."""
    while rows := list(itertools.islice(made, 256)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _ends(r: dict) -> tuple:
    return r["head"], r["head_size"], r["tail"], r["tail_size"]


def _square(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(raw, np.int64)
    return flat.reshape(int(round(len(flat) ** 0.5)), -1)


# The functions below read rows sorted by text and place, and hold a span at most.

_PRODUCT = pa.schema([("row", pa.int64()), ("span", pa.int32()), ("matrix", pa.binary())])
_START = pa.schema([("row", pa.int64()), ("span", pa.int32()), ("start", pa.binary())])
_STATE = pa.schema([("row", pa.int64()), ("span", pa.int32()), ("leave", pa.int32())])
_ENTERED = pa.schema([("row", pa.int64()), ("span", pa.int32()), ("k", pa.int32()), ("head", pa.string()), ("head_size", pa.int32()), ("tail", pa.string()), ("tail_size", pa.int32()), ("entry", pa.binary()), ("map", pa.binary())])
_TRACED = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("part", pa.int32()), ("ids", pa.list_(pa.int32()))])


def _span_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups = itertools.groupby(_rows(batches), lambda r: (r["row"], r["span"]))
    return _batches(((*key, product([_square(r["matrix"]) for r in group]).tobytes()) for key, group in groups), _PRODUCT)


def _span_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made():
        for row, group in itertools.groupby(_rows(batches), lambda r: r["row"]):
            start = None
            for r in group:
                m = _square(r["matrix"])
                if start is None:
                    start = np.full(len(m), _LOW, np.int64)
                    start[0] = 0
                yield row, r["span"], start.tobytes()
                start = after(start, m)

    return _batches(made(), _START)


def _enter(model_path: str):
    """The state scores in front of each chunk of a span, its map of states, and
    behind a span's chunks the map of the whole span (without a ``k``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = cache_of(model_path).vocabulary

        def made():
            for key, group in itertools.groupby(_rows(batches), lambda r: (r["row"], r["span"])):
                scores = np.frombuffer(next(group)["start"], np.int64)
                whole = np.arange(len(scores), dtype=np.int16)
                for r in group:
                    states = vocabulary.entering(scores, *_ends(r))
                    yield *key, r["k"], *_ends(r), scores.tobytes(), states.tobytes()
                    whole = np.where(states >= 0, whole[states], -1).astype(np.int16)
                    scores = after(scores, _square(r["matrix"]))
                yield *key, None, None, None, None, None, None, whole.tobytes()

        return _batches(made(), _ENTERED)

    return run


def _span_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State in which each span is left; the last one comes first and is left in 0."""

    def made():
        for row, group in itertools.groupby(_rows(batches), lambda r: r["row"]):
            state = 0
            for r in group:
                yield row, r["span"], state
                state = int(np.frombuffer(r["map"], np.int16)[state])

    return _batches(made(), _STATE)


def _trace(model_path: str):
    """Ids of the ends of each chunk; the last chunk of a span comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = cache_of(model_path).vocabulary

        def made():
            for (row, _), group in itertools.groupby(_rows(batches), lambda r: (r["row"], r["span"])):
                state = next(group)["leave"]
                for r in group:
                    for part, ids in zip((0, 2), vocabulary.trace(np.frombuffer(r["entry"], np.int64), state, *_ends(r))):
                        yield row, r["k"], part, ids
                    state = int(np.frombuffer(r["map"], np.int16)[state])

        return _batches(made(), _TRACED)

    return run


def _scan(rows: DataFrame, model_path: str, chunk: int) -> DataFrame:
    """doc_id, text and ids of texts of several chunks."""
    n = partitions(rows.sparkSession)
    vocabulary = cache_of(model_path).vocabulary
    texts = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "long-texts")
    chunks = texts.select("row", "text").mapInArrow(_split(chunk, vocabulary.longest), "row bigint, k int, chunk string, size int")
    chunks = materialize(chunks.repartition(n, "row", "k").mapInArrow(_prepare(model_path), _PREPARED), "chunks")
    placed = chunks.withColumn("span", F.floor(F.col("k") / SPAN).cast("int"))

    def dealt(df: DataFrame, by: list, order: list) -> DataFrame:
        """Dealt out by number, as adaptive execution would put small rows into one
        task."""
        return df.repartition(n, *by).sortWithinPartitions(*by, *order)

    spans = dealt(placed.select("row", "span", "k", "matrix"), ["row", "span"], ["k"]).mapInArrow(_span_products, "row bigint, span int, matrix binary")
    starts = dealt(spans, ["row"], ["span"]).mapInArrow(_span_starts, "row bigint, span int, start binary")
    first = starts.withColumn("kind", F.lit(0)).unionByName(placed.drop("middle").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    entered = dealt(first, ["row", "span"], ["kind", "k"]).mapInArrow(_enter(model_path), "row bigint, span int, k int, head string, head_size int, tail string, tail_size int, entry binary, map binary")
    entered = materialize(entered, "entered")

    maps = entered.where("k is null").select("row", "span", "map")
    states = dealt(maps, ["row"], [F.col("span").desc()]).mapInArrow(_span_states, "row bigint, span int, leave int")
    last = states.withColumn("kind", F.lit(0)).unionByName(entered.where("k is not null").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    traced = dealt(last, ["row", "span"], ["kind", F.col("k").desc()]).mapInArrow(_trace(model_path), "row bigint, k int, part int, ids array<int>")

    pieces = traced.unionByName(chunks.select("row", "k", F.lit(1).alias("part"), F.col("middle").alias("ids")))
    whole = pieces.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "part", "ids"))), lambda x: x["ids"])).alias("ids"))
    if not vocabulary.byte_ids:
        unknown = F.lit(vocabulary.unknown_id)
        whole = whole.withColumn("ids", F.filter("ids", lambda x, i: (x != unknown) | (i == 0) | (F.get("ids", i - 1) != unknown)))
    return texts.join(whole, "row").select("doc_id", "text", "ids")


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, text and ids (array of int) per row; texts of more than ``chunk``
    characters, with the blank in front, are scanned in chunks of so many."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    several = F.coalesce(F.length("text") >= chunk, F.lit(False))
    return rows.where(~several).mapInArrow(_encode(model_path), schema).unionByName(_scan(rows.where(several), model_path, chunk))


def decode(encoded: DataFrame, model_path: str, *, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for (null for null ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = cache_of(model_path).vocabulary.text
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(part.schema.get_field_index(ids_col))
                values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                texts = [b"".join([table[i] for i in values[a:b].tolist()]).decode("utf-8", "replace")[1:] for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))], names=[*part.schema.names, into])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())]))
