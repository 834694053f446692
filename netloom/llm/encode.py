"""Encoding of whole texts with a public byte-level BPE tokenizer.

The vocabulary is a rank file whose path is a parameter; each Python worker loads it once.
Texts are encoded whole. Long ones are first cut where the tokenizer's own pre-splitting always cuts (a
blank, tab or line end after something that is no white space; between a letter and a digit; before a sign that follows a letter or
digit; before a digit that follows a sign), so the ids are the same as
those of the uncut text, and one call sees about ``CUT`` characters at most; only a longer run of nothing but letters, digits or signs
goes in one piece. The rank file is sent to the executors with the job.

Defined results
---------------
* null and empty texts: an empty list. No special tokens are added; text that looks like
  one is ordinary text.
* ``decode_bytes`` gives back the bytes of a list of ids, so a token that ends inside a character
  loses nothing; ids outside the vocabulary give null.
* repeated rows are encoded each; the input's other columns stay (``keep``).
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CUT = 50_000
#: The pre-splitting pattern that belongs to the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"  # letters in every version of Unicode
_SIGN = r"!-/:-@\[-`{-~"
_SAFE = re.compile(rf"(?<=\S)(?=[ \n\t])|(?<=[{_LETTER}])(?=[0-9{_SIGN}])|(?<=[0-9])(?=[{_LETTER}{_SIGN}])|(?<=[{_SIGN}])(?=[0-9])")


def vocabulary_dir() -> str:
    """Where the public vocabularies lie: NETLOOM_TOKENIZERS, or the installed package's folder."""
    if named := os.environ.get("NETLOOM_TOKENIZERS"):
        return named
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    return {i: b for b, i in ranks(path).items()}


def pieces(text: str, cut: int = CUT) -> list[str]:
    """The text in pieces that are pre-split alike alone and together."""
    if len(text) <= cut:
        return [text]
    out, start = [], 0
    while len(text) - start > cut:
        m = _SAFE.search(text, start + cut)
        if not m or m.start() >= len(text):
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def encode(text: str | None, path: str, cut: int = CUT) -> list[int]:
    if not text:
        return []
    enc = encoding(path)
    if len(text) <= cut:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text, cut) for i in enc.encode_ordinary(p)]


def decode_bytes(ids: list[int], path: str) -> bytes | None:
    known = token_bytes(path)
    try:
        return b"".join(known[i] for i in ids)
    except KeyError:
        return None


def ship(spark: SparkSession, path: str) -> None:
    spark.sparkContext.addFile(path)


def here(path: str) -> str:
    """The rank file where it lies on this machine: sent along with the job, else at its own place."""
    sent = SparkFiles.get(os.path.basename(path))
    return sent if os.path.exists(sent) else path


def encode_texts(df: DataFrame, *, text: str = "text", keep: list[str], path: str, out: str = "ids", counts_only: bool = False) -> DataFrame:
    """``keep`` columns plus the token ids of each text (or their number); no shuffle."""
    import netloom.llm.encode as me

    me.ship(df.sparkSession, path)
    kind = T.IntegerType() if counts_only else T.ArrayType(T.IntegerType())
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks_at = me.here(path)
        for b in batches:
            ids = [me.encode(t, ranks_at) for t in b["__text"].to_pylist()]
            col = pa.array([len(i) for i in ids], pa.int32()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], col], names=[*keep, out])

    return df.select(*[f"`{c}`" for c in keep], df[f"`{text}`"].alias("__text")).mapInArrow(run, schema)


def decode_texts(df: DataFrame, *, ids: str = "ids", keep: list[str], path: str, out: str = "text") -> DataFrame:
    """``keep`` columns plus the text of each id list; bytes that are no UTF-8 become U+FFFD."""
    import netloom.llm.encode as me

    me.ship(df.sparkSession, path)
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks_at = me.here(path)
        for b in batches:
            raw = [None if i is None else me.decode_bytes(i, ranks_at) for i in b["__ids"].to_pylist()]
            col = pa.array([None if r is None else r.decode("utf-8", "replace") for r in raw], pa.string())
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], col], names=[*keep, out])

    return df.select(*[f"`{c}`" for c in keep], df[f"`{ids}`"].alias("__ids")).mapInArrow(run, schema)
