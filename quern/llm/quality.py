"""Document quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule votes good (1), bad (0) or abstains (-1).  Votes depend on the document alone, so documents with the same
votes have the same posterior, and the counts of the vote patterns (at most 3 ^ rules of them, whatever the corpus)
are all that the estimation needs: it runs over all documents.  The model is a two-class latent variable with votes
independent given the class; an abstention says nothing.  Each rule has two accuracies: how often it votes good on
good documents (high, as the Beta prior has it) and bad on bad ones (often low: a bad document trips a rule or two).
The priors also settle which class is the good one.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ready, written

SYMBOLS = b"#*$%&|<>"  # fixed values of the contract
RULES = ("length", "symbols", "dup_lines", "repeats", "capitals", "word_length", "clean_words", "tables", "sentences", "closed_words")
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, votes string"
_CLEAN = re.compile(r"(?<!\S)[^\W\d_]+[.,;:!?]?(?!\S)")
_CAPS = re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{2,}\b")


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more in the text, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    k = len(ids)
    if k < 2_000_000:
        key = (x[:-2] * k + x[1:-1]) * k + x[2:]
    else:
        pair = np.unique(x[:-2] * k + x[1:-1], return_inverse=True)[1]
        key = pair * k + x[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    hit[:-2] |= again
    hit[1:-1] |= again
    hit[2:] |= again
    return int(hit.sum())


def votes_of(n_words, word_chars, n_symbols, n_lines, n_dup, n_repeat, caps, clean, bars, ended, distinct) -> str:
    """One character a rule, in the order of RULES: g, b or - for an abstention."""

    def vote(value, good, bad):
        return "g" if good(value) else "b" if bad(value) else "-"

    if not n_words:
        return "b" + "-" * (len(RULES) - 1)
    r = n_words
    return "".join((
        vote(n_words, lambda v: v >= 100, lambda v: v < 50),
        vote(n_symbols / r, lambda v: v < 0.05, lambda v: v > 0.2),
        vote(n_dup / max(n_lines, 1), lambda v: v < 0.2, lambda v: v > 0.5) if n_lines > 2 else "-",
        vote(n_repeat / r, lambda v: v < 0.15, lambda v: v > 0.3),
        vote(caps / r, lambda v: v < 0.1, lambda v: v > 0.3),
        vote(word_chars / r, lambda v: 3 <= v <= 9, lambda v: v < 2 or v > 12),
        vote(clean / r, lambda v: v > 0.8, lambda v: v < 0.5),
        vote(bars / r, lambda v: v < 0.02, lambda v: v > 0.1),
        vote(ended / max(n_lines, 1), lambda v: v > 0.7, lambda v: v < 0.2),
        # How the vocabulary grows with the text, as an exponent: alike for short texts and long ones.
        vote(math.log(distinct) / math.log(n_words), lambda v: v > 0.75, lambda v: v < 0.6) if n_words > 1 else "-",
    ))


def features_of(text: str) -> tuple:
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    word_chars = len(b"".join(words).decode("utf-8", "replace")) if n else 0
    n_symbols = sum(raw.count(s) for s in (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    n_dup = len(lines) - len(set(lines))
    n_repeat = repeat_words(words)
    failed = n < 50 or 100 * n_repeat > 50 * n
    caps = len(_CAPS.findall(text))
    kinds = set(words)
    bars = words.count(b"|")
    clean = len(_CLEAN.findall(text))
    ended = sum(x.rstrip().endswith((b".", b"!", b"?", b":", b'"')) for x in lines)
    votes = votes_of(n, word_chars, n_symbols, len(lines), n_dup, n_repeat, caps, clean, bars, ended, len(kinds))
    return n, word_chars, n_symbols, n_dup, n_repeat, failed, votes


def vote_frame(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES for each row of docs."""
    ready(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "votes"]

    @F.pandas_udf(FEATURES)
    def told(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features_of(t if isinstance(t, str) else "") for t in texts], columns=names)

    return docs.select("doc_id", told("text").alias("f")).select("doc_id", "f.*")


def estimate(patterns: dict[str, int], rounds: int = 200, priors: tuple[tuple[float, float], tuple[float, float]] = ((49.0, 1.0), (2.0, 4.0))) -> tuple[dict[str, float], float, np.ndarray]:
    """Posterior of good for each pattern, the share of good documents, and each rule's accuracy (on good, on bad).

    A prior counts as so many right and wrong votes, and the share's as one good and a tenth of a bad document, for
    every thousand documents: it weighs alike in a large corpus and in a small one.  Without documents there is
    nothing to estimate: an empty dict, 0.5 and the priors' accuracies.
    """
    keys = sorted(patterns)
    a = np.array([[r / (r + x)] * len(RULES) for r, x in priors])
    if not keys:
        return {}, 0.5, a
    v = np.array([[{"g": 1, "b": 0, "-": -1}[c] for c in k] for k in keys])
    w = np.array([patterns[k] for k in keys], float)
    good, bad = (v == 1).astype(float), (v == 0).astype(float)
    scale = max(1.0, w.sum() / 1000)
    post = 1 / (1 + np.exp(4 * bad.sum(axis=1) - good.sum(axis=1)))
    share = 0.5
    for _ in range(rounds):
        share = (float(w @ post) + scale) / (float(w.sum()) + 1.1 * scale)
        share = min(max(share, 0.01), 0.99)
        for k, p in ((0, post), (1, 1 - post)):
            right, wrong = ((good, bad), (bad, good))[k]
            r, x = (w * p) @ right + priors[k][0] * scale, (w * p) @ wrong + priors[k][1] * scale
            a[k] = np.clip(r / (r + x), (0.6, 0.05)[k], 0.999)
        log = np.log(share / (1 - share)) + good @ np.log(a[0] / (1 - a[1])) + bad @ np.log((1 - a[0]) / a[1])
        new = 1 / (1 + np.exp(-np.clip(log, -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(keys, post.tolist())), share, a


def score_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, votes, quality (posterior of good) and kept, for each row of docs.

    Words are runs of characters other than ASCII white space.  A null or empty text has none: it fails the base
    rules and is not kept.  Null doc_ids stay, repeated rows are scored alike, an empty table gives no rows, other
    columns are left out.  One pass over the texts; the counts are written once, being small.
    """
    rows = written(vote_frame(docs.select("doc_id", "text")), "votes")
    patterns = {r["votes"]: r["n"] for r in rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    post, _, _ = estimate(patterns)
    told = docs.sparkSession.createDataFrame(list(post.items()) or [("", 0.0)], "votes string, quality double")
    out = rows.join(F.broadcast(told), "votes", "left")  # at most 3 ^ rules rows
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
