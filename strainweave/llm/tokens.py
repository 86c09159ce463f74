"""Tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Place of the vocabulary files; every executor has it.
FOLDER = os.environ.get("STRAINWEAVE_TOKENIZERS", "/opt/tokenizers")
#: The tokenizer that results name unless another is given.
NAME = "byte_bpe_50k"

# Fixed value: the pattern that cuts a text before its parts are encoded, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, tuple] = {}


def load(path: str) -> tuple:
    """(encoding, length in bytes of every token) of a .tiktoken file; once a worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _LOADED[path]


def vocabulary(name: str = NAME, folder: str = FOLDER) -> str:
    """The file of a tokenizer."""
    return os.path.join(folder, f"{name}.tiktoken")


def n_tokens(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text; 0 for null and empty ones."""
    path = path or vocabulary()

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load(path)[0].encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int32")

    return count(text)
