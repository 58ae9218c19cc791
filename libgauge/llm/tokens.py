"""Token ids of whole texts by a public byte-level BPE vocabulary.

Ids are those that the ``tokenizers`` library gives for ``byte_bpe_50k.json`` with
``add_special_tokens=False``: the vocabulary's added token, spelt out in a text, is one id.  Texts are
encoded by tiktoken, which reads the same vocabulary from its rank file at a fifth of the time; tests
compare the two.  Its pattern engine can't take white space of any length (it fails beyond some
300,000 characters), so texts with a run of LONG_RUN and more go through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bounded_batches, fresh

#: White space of so many characters in a row is left to the tokenizers library.
LONG_RUN = 10_000
RUN = re.compile(r"\s{%d}" % LONG_RUN)
# The one added token of byte_bpe_50k.json and its id.
ADDED, ADDED_ID = "<|endoftext|>", (50256).to_bytes(4, "little")


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def library(json_path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit bytes."""

    def __init__(self, ranks_path: str, json_path: str):
        import public_tokenizers

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.json_path = json_path

    def ids(self, text: str) -> bytes:
        if RUN.search(text):
            return array("I", library(self.json_path).encode(text, add_special_tokens=False).ids).tobytes()
        return ADDED_ID.join(array("I", self.plain(part)).tobytes() for part in text.split(ADDED))


@lru_cache(2)
def encoder(ranks_path: str | None = None, json_path: str | None = None) -> Encoder:
    return Encoder(ranks_path or vocabulary_path(), json_path or vocabulary_path("byte_bpe_50k.json"))


def count_tokens(df: DataFrame, keep: list[str], text_col: str, name: str) -> DataFrame:
    """The columns of ``keep`` and the number of each text's ids; a null text has none."""
    bounded_batches(df.sparkSession)
    (text,) = fresh([*keep, name], "text")
    rows = df.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{text_col}`").cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder().ids
        for b in batches:
            counts = [len(encode(t or "")) // 4 for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(counts, pa.int64())], names=[*keep, name])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[k] for k in keep), T.StructField(name, T.LongType())]))
