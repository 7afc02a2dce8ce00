"""Sizes of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the splitting pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
_MEMO = 400_000


class _Memo(dict):
    """Token counts of pieces; missing ones are counted."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) < 40 and len(self) < _MEMO:
            self[piece] = n
        return n


@lru_cache(maxsize=4)
def _counter(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    first, rest = _Memo(encode), _Memo(lambda piece: encode(" " + piece))

    def count(text: str) -> int:
        # No token spans the place before a single blank that a word follows, so pieces
        # cut there can be counted apart, and each distinct piece once.
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return len(encode(text))
        head, *tail = text.split(" ")
        return first[head] + sum(map(rest.__getitem__, tail))

    return count


def count_tokens(texts: list[str | None], vocabulary: str = DEFAULT_VOCABULARY) -> list[int]:
    """Tokens of each text; 0 for null and empty."""
    count = _counter(vocabulary)
    return [count(t) if t else 0 for t in texts]


def _shipped(rows: DataFrame, vocabulary: str) -> str | None:
    """Name under which executors find the file; None where the session has no context of
    its own, and the path must be theirs too."""
    try:
        context = rows.sparkSession.sparkContext
    except Exception:
        return None
    context.addFile(vocabulary)
    return vocabulary.rsplit("/", 1)[-1]


def with_tokens(rows: DataFrame, *, text_col: str = "text", out: str = "tokens", vocabulary: str = DEFAULT_VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and ``out``, the size of the text.  ``vocabulary`` is a path on
    the driver's machine; Spark itself ships the file to the executors.  By default all
    columns are kept but the text and any named as ``out``; null and empty texts have size 0."""
    shipped = _shipped(rows, vocabulary)
    keep = keep if keep is not None else [c for c in rows.columns if c not in (text_col, out)]
    src = rows.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keep).schema.fields] + [f"`{out}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = SparkFiles.get(shipped) if shipped else vocabulary
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(count_tokens(part.column(len(keep)).to_pylist(), path), pa.int64())], names=[*keep, out])

    return src.mapInArrow(run, schema)
