"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tidemark.llm.arrowed import per_distinct

#: Ranks of the tokenizer; any file of the same format on all executors will do.
PATH = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how this vocabulary's tokenizer splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = PATH) -> Column:
    """Number of tokens of a whole text; null counts 0."""

    @arrow_udf(T.LongType())
    def count(values: pa.Array) -> pa.Array:
        encode = encoding(path).encode_ordinary
        return per_distinct(values.fill_null(""), lambda t: len(encode(t)) if t else 0, pa.int64())

    return count(text)
