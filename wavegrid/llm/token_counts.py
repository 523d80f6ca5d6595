"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is cut into pieces at safe boundaries when it is long, pieces are
gathered into batches of about equal bytes across row borders, each batch is
encoded at once and only the number of tokens leaves the function.

Which places are safe follows from the tokenizer's own description
(:func:`safe_cuts`).  Where it splits at white space, or in the manner of
byte-level vocabularies, a cut is made before a white-space character that follows
a character which is not white space; in the latter also between an ASCII letter
and a digit.  No pre-token extends over such a place, and none looks back over
it, so the counts of the pieces add up to the count of the whole.  A tokenizer of
any other kind (one that puts a blank in front, normalises by context or has
its own pattern) gets whole texts, and a text without a safe place stays whole.

Cases: a null text counts as empty (0 bytes, 0 tokens); rows are independent, so
null ids, repeated ids and repeated rows each give their own row; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavegrid.llm.common import id_and_text
from wavegrid.runtime import ship

#: Bytes of text encoded at once, and characters from which a text is cut.
BATCH_BYTES = 1 << 18
PIECE_CHARS = 1 << 15

#: The last character before a cut, by kind of tokenizer.
_CUTS = {"space": re.compile(r"\S(?=[ \n\t\r])"), "byte-level": re.compile(r"\S(?=[ \n\t\r])|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")}
_encoders: dict[str, tuple] = {}


def safe_cuts(described: dict) -> re.Pattern | None:
    """Where texts may be cut for a tokenizer with this description (the content of
    its file), or None."""

    def steps(part: dict | None, inner: str) -> list[dict]:
        if not part:
            return []
        return [x for p in part[inner] for x in steps(p, inner)] if part["type"] == "Sequence" else [part]

    if any(re.search(r"\s", x["content"]) or x.get("lstrip") or x.get("rstrip") for x in described.get("added_tokens") or []):
        return None
    if any(x["type"] not in ("NFC", "Lowercase") for x in steps(described.get("normalizer"), "normalizers")):
        return None
    split = steps(described.get("pre_tokenizer"), "pretokenizers")
    if not split:
        return None
    if all(x["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") for x in split):
        return _CUTS["space"]
    if len(split) == 1 and split[0]["type"] == "ByteLevel" and not split[0].get("add_prefix_space", True) and split[0].get("use_regex", True):
        # Composition and case folding keep letters and digits apart as well.
        return _CUTS["byte-level"]
    return None


def pieces(text: str, size: int = PIECE_CHARS, cut: re.Pattern = _CUTS["byte-level"]) -> Iterator[str]:
    """``text`` in pieces of ``size`` characters or a little more."""
    start = 0
    while len(text) - start > size:
        found = cut.search(text, start + size - 1)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


def _encoder(path: str) -> tuple:
    """(function from texts to token counts, where texts may be cut or None)."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _encoders[path] = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], None)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            encode = getattr(model, "encode_batch_fast", model.encode_batch)
            _encoders[path] = (lambda texts: [len(x) for x in encode(texts, add_special_tokens=False)], safe_cuts(json.loads(model.to_str())))
    return _encoders[path]


def _lengths(path: str, batch_bytes: int, piece_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cut = _encoder(path)
        for batch in batches:
            texts, rows = batch.column(1), batch.num_rows
            n_bytes, n_tokens = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            waiting, owners, held = [], [], 0

            def flush():
                np.add.at(n_tokens, owners, count(waiting))
                waiting.clear()
                owners.clear()

            for i in range(rows):
                text = texts[i].as_py()
                if not text:
                    continue
                for piece in pieces(text, piece_chars, cut) if cut else (text,):
                    size = len(piece.encode())
                    n_bytes[i] += size
                    waiting.append(piece)
                    owners.append(i)
                    held += size
                    if held >= batch_bytes:
                        flush()
                        held = 0
            if waiting:
                flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, batch_bytes: int = BATCH_BYTES, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) per row.

    ``model_path`` names a ``.json`` file for the tokenizers library or a
    ``.model`` file for sentencepiece; each worker loads it once.  No begin,
    end or other special token is added.
    """
    ship(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(_lengths(model_path, batch_bytes, piece_chars), schema).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
