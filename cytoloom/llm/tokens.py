"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"


@lru_cache(maxsize=4)
def _encoders(folder: str, name: str):
    import runpy

    import tiktoken
    from tokenizers import Tokenizer

    pattern = runpy.run_path(os.path.join(folder, "__init__.py")).get("PATTERN")
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
    slow.encode_special_tokens = True
    return fast, slow


def n_tokens(texts: list[str | None], folder: str = TOKENIZERS, name: str = VOCABULARY) -> list[int]:
    """Tokens of each text; 0 for null and empty ones. Texts that the faster encoder can't take (white space by
    the hundred thousand) go through the other one, over the same vocabulary."""
    fast, slow = _encoders(folder, name)
    out = []
    for t in texts:
        if not t:
            out.append(0)
            continue
        try:
            if _longest_blank(t) > 10_000:
                raise ValueError
            out.append(len(fast.encode_ordinary(t)))
        except BaseException as e:  # the encoder's own panics aren't Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            out.append(len(slow.encode(t, add_special_tokens=False).ids))
    return out


def _longest_blank(t: str) -> int:
    if len(t) < 10_000 or len(t) - len("".join(t.split())) < 10_000:
        return 0
    return max((len(x) for x in re.findall(r"\s+", t)), default=0)


def token_count(text: Column, folder: str = TOKENIZERS, name: str = VOCABULARY) -> Column:
    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(n_tokens(s.tolist(), folder, name), dtype="int32")

    return count(text)
