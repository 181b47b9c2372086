"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words, and beginnings of words, that labelled toxic texts use far more often than others.
Features of a text are densities of lexicon hits, their closeness to the second person, capitals, punctuation and
obfuscated spellings.  Labels are learned from a bounded sample of labelled rows; scores are given to all rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import boosting
from quern.llm.common import ready, written

#: At most so many labelled rows are learned from: the first by a hash of their id.
SAMPLE = 20_000
#: At most so many entries of the lexicon.
LEXICON = 400
#: Lengths of word beginnings that may be entries, marked by a final "*".
STEMS = (4, 5, 6, 7)

# Second-person words of English, German, French and Spanish.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes tú ti tuyo vosotros".split())
# Characters that stand for letters in obfuscated spellings.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})

WORD = re.compile(r"[^\W\d_]+")
#: A run of word characters and stand-ins, and what makes it odd: a stand-in between letters.
RUN = re.compile(r"[\w@$*!]+")
ODD = re.compile(r"[^\W\d_][@$*!0-9]+[^\W\d_]")
STRETCHED = re.compile(r"(.)\1\1")
#: Words that a worker remembers the facts of.
REMEMBERED = 200_000

NAMES = ("hits", "hit_rate", "weight_rate", "strongest", "kinds", "local", "near_you", "near_you_rate", "you_rate", "caps_rate", "upper_rate", "bang_rate", "question_rate", "punct_rate", "odd_rate", "odd_hits", "stretched", "log_words", "word_len")


def stems(words: set[str]) -> set[str]:
    return {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


@lru_cache(maxsize=1)
def _upper() -> np.ndarray:
    """Of each code point, whether it is a capital."""
    return np.fromiter((chr(i).isupper() for i in range(0x110000)), bool, 0x110000)


class Reader:
    """Features of texts by a lexicon; remembers the facts of words."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.facts: dict[str, tuple] = {}

    def fact(self, word: str) -> tuple:
        """Lower-cased form, weight, whether it is of the second person, capitals alone, stretched."""
        low = word.lower()
        weight = max([self.lexicon.get(low, 0.0), *(self.lexicon.get(low[:k] + "*", 0.0) for k in STEMS if len(low) >= k)])
        return low, weight, low in SECOND, len(word) > 1 and word.isupper(), STRETCHED.search(low) is not None

    def features(self, text: str) -> list[float]:
        words = WORD.findall(text)
        n = len(words)
        facts = self.facts
        if len(facts) > REMEMBERED:
            facts.clear()
        kinds = set(words)
        for w in kinds:
            if w not in facts:
                facts[w] = self.fact(w)
        told = [facts[w] for w in words]
        at = [i for i, f in enumerate(told) if f[1]]
        scores = [told[i][1] for i in at]
        second = [i for i, f in enumerate(told) if f[2]]
        local = j = near = y = 0
        for i, place in enumerate(at):
            while place - at[j] > 50:
                j += 1
            local = max(local, i - j + 1)
            while y < len(second) and second[y] < place - 5:
                y += 1
            near += y < len(second) and second[y] <= place + 5
        low = {facts[w][0] for w in kinds}
        stretched = len({facts[w][0] for w in kinds if facts[w][4]})
        odd = [w for w in RUN.findall(text) if ODD.search(w)] if ODD.search(text) else []
        odd_hits = sum(1 for w in odd if w.lower().translate(LOOKALIKE) in self.lexicon)
        m, r = max(len(text), 1), max(n, 1)
        upper = int(_upper()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].sum())
        return [
            math.log1p(len(at)), 100 * len(at) / r, 100 * sum(scores) / r, max(scores, default=0.0), len({told[i][0] for i in at}), local, near, 100 * near / r,
            100 * len(second) / r, sum(f[3] for f in told) / r, upper / m, 100 * text.count("!") / m, 100 * text.count("?") / m,
            100 * (text.count(",") + text.count(".") + text.count(";") + text.count(":")) / m, 100 * len(odd) / r, odd_hits, stretched, math.log1p(n),
            sum(map(len, low)) / max(len(low), 1),
        ]


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    return Reader(lexicon).features(text)


def matrix(texts, reader: Reader) -> np.ndarray:
    rows = [reader.features(t if isinstance(t, str) else "") for t in texts]
    return np.array(rows, float).reshape(len(rows), len(NAMES))


def learn_lexicon(sample: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """The words and beginnings whose share of toxic texts stands out most; weights are shrunken log-odds.

    Of entries that hit the same texts the shorter says no more than the longer, so a beginning is an entry only if
    its log-odds are higher by their standard error than those of its longer forms together would be by chance: the
    ranking is by the lower end of a 95 % interval.
    """

    def counts(known: frozenset | None):
        """A term and how many texts of a task have it; of the known terms alone where there are such."""

        def run(frames):
            seen: Counter = Counter()
            for f in frames:
                for t in f["text"]:
                    words = set(WORD.findall(t.lower())) if isinstance(t, str) else set()
                    words |= stems(words)
                    seen.update(words if known is None else words & known)
            terms, n = list(seen), list(seen.values())
            for at in range(0, len(terms), 50_000):
                part = slice(at, at + 50_000)
                yield pd.DataFrame({"term": pd.Series(terms[part], dtype=object), "n": n[part]})

        return run

    def total(rows: DataFrame, known: frozenset | None, name: str) -> DataFrame:
        return rows.select("text").mapInPandas(counts(known), "term string, n long").groupBy("term").agg(F.sum("n").alias(name))

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    nt, nc = sizes.get(1, 0), sizes.get(0, 0)
    if not nt or not nc:
        return {}
    # A term of no toxic text is no entry.  Terms are those of the bounded sample's toxic texts, three of which have each.
    toxic = written(total(sample.where("toxic = 1"), None, "toxic").where("toxic >= 3"), "terms")
    known = frozenset(r["term"] for r in toxic.select("term").collect())
    clean = total(sample.where("toxic = 0"), known, "clean").withColumnRenamed("term", "t")
    rows = toxic.join(clean, toxic["term"] == clean["t"], "left").select("term", "toxic", F.coalesce("clean", F.lit(0)).alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (nt + 1)) - F.log((F.col("clean") + 0.5) / (nc + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    # Against one clean text, half a case is a weak denominator; the interval's lower end takes care of it.
    low = (odds - 1.96 * error).alias("low")
    top = rows.select("term", low).where("low > 0.7").orderBy(F.desc("low"), "term").limit(size).collect()
    return {r["term"]: float(r["low"]) for r in top}


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: boosting.Trees
    scale: boosting.Isotonic

    def score(self, texts) -> np.ndarray:
        if "_reader" not in self.__dict__:
            self._reader = Reader(self.lexicon)  # one for each task
        x = matrix(texts, self._reader)
        return np.clip(self.scale(self.trees.margin(x)), 0.0, 1.0) if len(x) else np.zeros(0)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_reader"}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic 0/1 (rows to learn from only).

    Labels other than 0 and 1 are left out; of several for a doc_id the largest counts.  Three parts of four grow the
    lexicon and the trees, the fourth calibrates; without toxic or without clean rows the score is the overall rate.
    """
    ready(docs.sparkSession)
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded: `sample` rows are broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4)))
    texts = written(texts, "labelled")
    grow = texts.where("part < 3")
    lexicon = learn_lexicon(grow)

    def rows(frames):
        reader = Reader(lexicon)
        for f in frames:
            x = matrix(f["text"], reader)
            yield pd.DataFrame({"x": list(x), "y": f["toxic"].astype(int), "part": f["part"]})

    got = texts.mapInPandas(rows, "x array<double>, y int, part long").toPandas()  # `sample` rows of len(NAMES) numbers
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(NAMES))
    y, fold = got["y"].to_numpy(float), got["part"].to_numpy() == 3
    trees = boosting.fit(x[~fold], y[~fold])
    held = trees.margin(x[fold])
    return Model(lexicon, trees, boosting.isotonic(held, y[fold]) if fold.any() else boosting.isotonic(trees.margin(x), y))


def score_column(model: Model):
    """A column function: text -> score."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts))

    return score


def score_toxicity(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs with the column `out`, 0 to 1.

    Null and empty texts get the score of a text without words; equal texts, those of repeated rows too, get equal scores;
    an empty table gives no rows; a column named like `out` is replaced, other columns stay.
    """
    ready(docs.sparkSession)
    return docs.withColumn(out, score_column(model)(F.col("text")))
