"""Token counts and token places by a public tokenizer, loaded once per worker process."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary lies if spark.quillspark.tokenizer doesn't say: a path that every worker can read.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SETTING = "spark.quillspark.tokenizer"
# Fixed value: how the vocabulary's texts were split into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def configured(spark: SparkSession) -> str:
    return spark.conf.get(SETTING, TOKENIZER)


@lru_cache(maxsize=4)
def encoding(path: str = TOKENIZER):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _lengths(path: str) -> np.ndarray:
    enc = encoding(path)
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], dtype=np.int64)


def count(text: str, path: str = TOKENIZER) -> int:
    return len(encoding(path).encode_ordinary(text))


def token_starts(text: str, path: str = TOKENIZER) -> np.ndarray:
    """The character each token starts in, ascending; tokens inside one character share it."""
    ids = np.array(encoding(path).encode_ordinary(text), dtype=np.int64)
    ends = np.cumsum(_lengths(path)[ids]) if len(ids) else np.zeros(0, dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1])) if len(ids) else ends
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    if len(raw) == len(text):
        return starts
    chars = np.cumsum((raw & 0xC0) != 0x80) - 1
    return chars[starts]


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text; 0 for null and empty texts."""

    @F.pandas_udf(T.LongType())
    def counts(texts: pd.Series) -> pd.Series:
        encoding(path)
        return texts.map(lambda t: count(t, path) if t else 0)

    return counts(F.coalesce(text, F.lit("")))
