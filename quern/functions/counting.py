"""Token counts by a public vocabulary: what prompts and observations cost."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # a special token's text in a prompt is ordinary text
    return t


@lru_cache(maxsize=4)
def _ranked(path: str):
    """The tiktoken form of a byte-level vocabulary, and the number of bytes of each id."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def token_counts(text: Column, path: str, ranks: str | None = None) -> Column:
    """tokens, and chars: the characters of all token strings, which a byte-level vocabulary has one of a byte.

    path: a vocabulary file that every executor has; it is opened once a worker.  ranks: the same vocabulary's file of ranks, by
    which tiktoken counts; it refuses very long runs of white space, and such texts are counted by path.  A null text has none.
    Texts are taken in Arrow batches, whole.
    """

    def plain(texts: list[str]) -> list[tuple[int, int]]:
        return [(len(e.ids), sum(map(len, e.tokens))) for e in _tokenizer(path).encode_batch(texts, add_special_tokens=False)]

    def ranked(t: str) -> tuple[int, int]:
        encoding, sizes = _ranked(ranks)
        try:
            ids = encoding.encode_to_numpy(t, disallowed_special=())
        except ValueError:
            return plain([t])[0]
        return len(ids), sizes[ids].sum()

    @F.pandas_udf("tokens long, chars long")
    def count(texts: pd.Series) -> pd.DataFrame:
        whole = [t or "" for t in texts]
        return pd.DataFrame(map(ranked, whole) if ranks else plain(whole), columns=["tokens", "chars"], dtype="int64")

    return count(text)


def fits(costs: Column, budget: int) -> Column:
    """Whether a prompt's messages fit a context, by the sum of their counts."""
    return F.aggregate(costs, F.lit(0).cast("long"), lambda a, c: a + c) <= budget
