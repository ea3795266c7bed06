"""Byte-level BPE token ids with a public vocabulary file, whose path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from colpattern.llm.common import tidy_udf

#: Ranks file of the default tokenizer (50,256 ids; 50256 is free and marks the end of a text).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text into the pieces within which bytes are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str = TOKENIZER):
    """The tokenizer of a ranks file, loaded once in a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def end_of_text(path: str = TOKENIZER) -> int:
    return encoding(path).n_vocab


def encode(text: str | None, path: str = TOKENIZER) -> np.ndarray:
    """Ids of a whole text; text that looks like a special token is ordinary text. None has no ids."""
    return np.array(encoding(path).encode_ordinary(text), np.uint32) if text else np.zeros(0, np.uint32)


def count_udf(path: str = TOKENIZER):
    """Column function text -> number of ids (null: 0)."""

    def count(texts: pa.Array) -> pa.Array:
        enc = encoding(path).encode_ordinary
        return pa.array([len(enc(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return F.arrow_udf(tidy_udf(count), "bigint")
