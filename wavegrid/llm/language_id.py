"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The likelihood of a text is the sum, over all ways to cut it into pieces, of the
product of the piece probabilities; a forward pass over the characters sums
them all.  Pieces never cross a word border, so a text's likelihood is the
product of its words', and a word's vector of log likelihoods is computed once
and kept in a bounded cache per worker.

Texts are lower-cased and only runs of letters count.  Piece counts come from
the vocabulary's own segmentation of a sample of about ``fit_rows`` labelled
texts per language (a threshold on a hash of the id), with additive smoothing;
the driver gets one count per language and piece.

Cases: ``und`` with score 0 for a text that is null, empty or has no letter,
and for every text if there is nothing to learn from; ties go to the language
that sorts first; rows are independent, so null and repeated ids and repeated
rows each give a row (but a null id is never learned from, nor is a null lang);
letters that the vocabulary lacks count as their UTF-8 bytes; an empty table of
documents gives an empty one; other columns are not read and can have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavegrid.llm.common import mix
from wavegrid.runtime import ship

UNDETERMINED = "und"
FIT_ROWS, SMOOTHING = 3000, 0.1

#: Words up to this length are scored together and cached; the cache's size.
SHORT, CACHE = 24, 300_000

_WORD = re.compile(r"[^\W\d_]+")
_MARK = "▁"


def pieces_of(model_path: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


@dataclass
class Model:
    """Piece probabilities; ``probabilities[i, j]`` is of piece i in language j."""

    languages: list[str]
    pieces: list[str]
    probabilities: np.ndarray
    index: dict[str, int] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.index = {p: i for i, p in enumerate(self.pieces) if not re.fullmatch(r"<.+>", p)}
        self.longest = max(map(len, self.index), default=1)
        names = {p: i for i, p in enumerate(self.pieces)}
        self.bytes = np.array([names.get(f"<0x{b:02X}>", -1) for b in range(256)])

    def __getstate__(self):
        return self.languages, self.pieces, self.probabilities

    def __setstate__(self, state):
        self.languages, self.pieces, self.probabilities = state
        self.__post_init__()

    def unknown(self, char: str) -> np.ndarray:
        """Probability of a character by its UTF-8 bytes."""
        at = self.bytes[list(char.encode())]
        return np.prod(np.where(at[:, None] >= 0, self.probabilities[at], 1e-9), axis=0)

    def word(self, word: str) -> np.ndarray:
        """Log likelihood of one word of any length, by a scaled forward pass."""
        text = _MARK + word
        alpha = [np.ones(len(self.languages))]
        total = np.zeros(len(self.languages))
        for i in range(1, len(text) + 1):
            now = np.zeros(len(self.languages))
            for back in range(1, min(i, self.longest, len(alpha)) + 1):
                at = self.index.get(text[i - back : i])
                if at is not None:
                    now += alpha[-back] * self.probabilities[at]
                elif back == 1:
                    now += alpha[-1] * self.unknown(text[i - 1])
            scale = now  # per language
            alpha = [a / scale for a in alpha[-self.longest :]] + [np.ones(len(now))]
            total += np.log(scale)
        return total

    def lookup(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A filter of hashes, the sorted hashes of the pieces, their indices."""
        if not hasattr(self, "_lookup"):
            items = list(self.index.items())
            hashes = np.array([_hash_of(p) for p, _ in items], np.uint64)
            order = np.argsort(hashes)
            maybe = np.zeros(1 << 22, bool)
            maybe[hashes >> np.uint64(42)] = True
            self._lookup = maybe, hashes[order], np.array([i for _, i in items])[order]
        return self._lookup

    def words(self, words: list[str]) -> np.ndarray:
        """Log likelihoods of words of at most ``SHORT`` characters, a row each;
        one forward pass for all words of a length."""
        out = np.zeros((len(words), len(self.languages)))
        lengths = np.array([len(w) for w in words])
        maybe, hashes, where = self.lookup()
        table = np.vstack([self.probabilities, np.zeros(len(self.languages))])
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            text = "".join(_MARK + words[r] for r in rows)
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(rows), n + 1)
            sums = np.zeros((len(rows), n + 2), np.uint64)
            for i in range(n + 1):
                sums[:, i + 1] = sums[:, i] * _STEP + codes[:, i] + np.uint64(1)
            alpha = np.zeros((len(rows), n + 2, len(self.languages)))
            alpha[:, 0] = 1
            powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n + 1, _STEP)]))
            for i in range(1, n + 2):
                for back in range(1, min(i, self.longest) + 1):
                    h = mix(sums[:, i] - sums[:, i - back] * powers[back])
                    near = np.flatnonzero(maybe[h >> np.uint64(42)])
                    found = np.full(len(rows), len(self.pieces))
                    at = np.minimum(np.searchsorted(hashes, h[near]), len(hashes) - 1)
                    hit = hashes[at] == h[near]
                    found[near[hit]] = where[at[hit]]
                    if back == 1:
                        alpha[:, i] += alpha[:, i - 1] * table[found]
                        for c in np.unique(codes[found == len(self.pieces), i - 1]):
                            lost = (found == len(self.pieces)) & (codes[:, i - 1] == c)
                            alpha[lost, i] += alpha[lost, i - 1] * self.unknown(chr(c))
                    else:
                        got = near[hit]
                        alpha[got, i] += alpha[got, i - back] * table[found[got]]
            likelihood = alpha[:, n + 1]
            for r in np.flatnonzero((likelihood < 1e-290).any(axis=1)):  # too small for a double
                likelihood[r] = 1.0
                out[rows[r]] = self.word(words[rows[r]])
            out[rows] += np.log(likelihood)
        return out


_STEP = np.uint64(0xD6E8FEB86659FD93)


def _hash_of(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_STEP) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([h], np.uint64))[0])


class Scorer:
    """Sums word vectors of texts, with a cache of words that is emptied when
    full."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        self.vectors = np.zeros((0, len(model.languages)))

    def _learn(self, words: set[str]) -> None:
        if len(self.rows) + len(words) > CACHE:
            self.rows, self.vectors = {}, np.zeros((0, len(self.model.languages)))
        new = sorted(words)
        letters = np.array([any(map(str.isalpha, w)) for w in new], bool)
        vectors = np.zeros((len(new), self.vectors.shape[1]))
        if letters.any():
            vectors[letters] = self.model.words([w for w, ok in zip(new, letters) if ok])
        self.rows.update(zip(new, range(len(self.vectors), len(self.vectors) + len(new))))
        self.vectors = np.concatenate([self.vectors, vectors])

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        split = [_WORD.findall(t.lower()) if t else [] for t in texts]
        at = 0
        totals = np.zeros((len(texts), len(self.model.languages)))
        while at < len(split):  # as many texts at a time as add few enough new words
            new: set[str] = set()
            end = at
            while end < len(split) and (end == at or len(new) < CACHE // 4):
                new.update(w for w in split[end] if w not in self.rows and len(w) <= SHORT)
                end += 1
            if len(new) > CACHE:  # one text with that many words
                for i in range(at, end):
                    for w in split[i]:
                        if any(map(str.isalpha, w)):
                            totals[i] += self.model.word(w)
                at = end
                continue
            if len(self.rows) + len(new) > CACHE:  # the cache is emptied: all words of these texts are new
                new = {w for i in range(at, end) for w in split[i] if len(w) <= SHORT}
                self.rows, self.vectors = {}, self.vectors[:0]
            self._learn(new)
            get = self.rows.get
            for i in range(at, end):
                rows = [r for r in map(get, split[i]) if r is not None]
                totals[i] = self.vectors[rows].sum(axis=0) if rows else 0
                if len(rows) < len(split[i]):
                    for w in split[i]:
                        if len(w) > SHORT and any(map(str.isalpha, w)):
                            totals[i] += self.model.word(w)
            at = end
        best = totals.argmax(axis=1)
        with np.errstate(under="ignore"):
            share = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
        known = totals.any(axis=1)
        return [self.model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, known)], np.where(known, share, 0.0)


def _count(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                lang, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or ""
                words = _WORD.findall(text.lower())
                total = counts.setdefault(lang, np.zeros(size, np.int64))
                for at in range(0, len(words), 10_000):
                    total += np.bincount(model.encode(" ".join(words[at : at + 10_000]), num_threads=1), minlength=size)
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], names=["lang", "piece", "n"])

    return run


def fit(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", eligible: Column | None = None, fit_rows: int = FIT_ROWS, smoothing: float = SMOOTHING) -> Model:
    """Learns piece probabilities from the rows that fulfil ``eligible`` (a
    condition on the id, column ``doc_id``) and have a language."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("doc_id is not null and lang is not null")
    if eligible is not None:
        rows = rows.where(eligible)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    pieces = pieces_of(model_path)
    languages = sorted(sizes)
    if not languages:
        return Model([], pieces, np.zeros((len(pieces), 0)))
    span = 1 << 30
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(span, -(-span * fit_rows // n))))))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < share[F.col("lang")]).select("lang", "text")
    found = sample.mapInArrow(_count(model_path), "lang string, piece bigint, n bigint").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(pieces), len(languages)))
    counts[found["piece"].to_numpy(dtype=np.int64), [languages.index(x) for x in found["lang"]]] = found["n"]
    counts += smoothing
    return Model(languages, pieces, counts / counts.sum(axis=0))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            langs: list[str] = []
            scores: list[np.ndarray] = [np.zeros(0)]
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                if model.languages:
                    lang, score = scorer.texts(texts)
                else:
                    lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                langs += lang
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the share of the best language in the sum of
    all likelihoods) per row, in one pass without a shuffle."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predict(model), schema)
