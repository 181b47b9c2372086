"""Language identification with hyperdimensional profiles.

Every letter of any script has a random vector of +1 and -1 of its own.  A trigram's vector binds (multiplies) those of its letters, rotated
by two, one and no places, so that order counts.  A text bundles (adds) its trigrams' vectors, a language the
normalised vectors of its sample texts; the nearest language by cosine is the prediction.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ready

DIMENSIONS = 1024
#: At most so many labelled texts are learned from: the first by a hash of their id.
SAMPLE = 20_000
#: Letters whose vectors a worker keeps at a time.
LETTERS = 16_384
UNKNOWN = "und"


def _mix(x: np.ndarray) -> np.ndarray:
    for shift in (32, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _lowered() -> np.ndarray:
    """Of each code point the lower-cased letter, 0 for what is no letter."""
    out = np.zeros(0x110000, np.int64)
    for cp in range(len(out)):
        c = chr(cp)
        if c.isalpha():
            out[cp] = ord(c.lower()[0])
    return out


class Space:
    """The letters' vectors, the same in every process: each code point has its own, from a hash with the seed."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7, keep: int = LETTERS):
        self.dimensions, self.keep = dimensions, keep
        self.seed = _mix(np.array([seed], np.uint64))
        self._clear()

    def _clear(self) -> None:
        self.row = np.full(0x110000, -1, np.int32)
        self.rows = 0
        self.vectors = np.zeros((3, 64, self.dimensions), np.int8)  # of each letter, rotated by 2, 1 and 0 places

    def letters(self, cp: np.ndarray) -> np.ndarray:
        """The vectors of code points; what is no letter (0) has one as well."""
        words = -(-self.dimensions // 64)
        x = cp.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)
        bits = np.unpackbits(_mix(_mix(x ^ self.seed)).view(np.uint8).reshape(len(cp), -1), axis=1)
        return bits[:, : self.dimensions].astype(np.int8) * 2 - 1

    def _rows(self, cp: np.ndarray) -> np.ndarray:
        new = np.unique(cp[self.row[cp] < 0])
        if len(new):
            if self.rows and self.rows + len(new) > self.keep:
                self._clear()
                return self._rows(cp)
            to = self.rows + len(new)
            if to > self.vectors.shape[1]:
                more = np.zeros((3, max(to, 2 * self.vectors.shape[1]), self.dimensions), np.int8)
                more[:, : self.rows] = self.vectors[:, : self.rows]
                self.vectors = more
            v = self.letters(new)
            for i in range(3):
                self.vectors[i, self.rows : to] = np.roll(v, 2 - i, axis=1)
            self.row[new] = np.arange(self.rows, to)
            self.rows = to
        return self.row[cp]

    def trigrams(self, text: str) -> np.ndarray:
        """Three code points of 21 bits each; 0 stands for what is no letter, once where there are several."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        s = np.zeros(len(cp) + 2, np.int64)  # a text begins and ends between words
        s[1:-1] = _lowered()[cp]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        s = s[keep]
        return s[:-2] << 42 | s[1:-1] << 21 | s[2:] if len(s) > 2 else np.zeros(0, np.int64)

    def bundle(self, text: str) -> np.ndarray | None:
        """The text's vector, None without a letter."""
        codes = self.trigrams(text)
        if not len(codes):
            return None
        unique, counts = np.unique(codes, return_counts=True)
        out = np.zeros(self.dimensions, np.float32)
        last = (1 << 21) - 1
        for at in range(0, len(unique), 2048):
            u = unique[at : at + 2048]
            r = self._rows(np.concatenate([u >> 42, u >> 21 & last, u & last])).reshape(3, -1)
            v = self.vectors[0][r[0]] * self.vectors[1][r[1]]
            v *= self.vectors[2][r[2]]
            out += counts[at : at + 2048].astype(np.float32) @ v.astype(np.float32)
        return out


_SPACE: list[Space] = []


def space() -> Space:
    """One for each Python worker."""
    if not _SPACE:
        _SPACE.append(Space())
    return _SPACE[0]


def unit(v: np.ndarray) -> np.ndarray:
    n = float(np.sqrt(v @ v))
    return v / n if n else v


@dataclass
class Profiles:
    languages: list[str]
    vectors: np.ndarray  # a unit row for each language
    sharpness: float = 25.0

    def predict(self, text) -> tuple[str, float]:
        """The nearest language, and a softmax of the cosines; UNKNOWN and 0 without a letter or a profile."""
        v = space().bundle(text) if isinstance(text, str) and text else None
        if v is None or not self.languages:
            return UNKNOWN, 0.0
        cos = self.vectors @ unit(v)
        best = int(cos.argmax())
        e = np.exp(self.sharpness * (cos - cos[best]))
        return self.languages[best], float(1 / e.sum())


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Profiles:
    """labelled: doc_id, text, lang; rows without text or lang are left out.  Ties between languages go by name."""
    ready(labelled.sparkSession)
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    # Ids alone are ordered; texts are read for the `sample` chosen, which are broadcast.
    ids = rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = rows.join(F.broadcast(ids), "doc_id").repartition(16, "doc_id")

    def bundles(frames):
        sums: dict[str, np.ndarray] = {}
        for f in frames:
            for text, lang in zip(f["text"], f["lang"]):
                v = space().bundle(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + unit(v).astype(float)
        yield pd.DataFrame({"lang": list(sums), "v": [v.tolist() for v in sums.values()]})

    total: dict[str, np.ndarray] = {}
    for r in chosen.mapInPandas(bundles, "lang string, v array<double>").collect():  # 16 rows a language
        total[r["lang"]] = total.get(r["lang"], 0) + np.array(r["v"])
    names = sorted(total)
    return Profiles(names, np.array([unit(total[x]) for x in names], np.float32).reshape(len(names), DIMENSIONS))


def predict_language(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """docs with lang_pred and score.

    Null texts and texts without a letter get UNKNOWN and 0; equal texts, those of repeated rows too, get equal
    predictions; an empty table gives no rows; columns named lang_pred or score are replaced, other columns stay.
    """
    ready(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    # Under a name that no column of docs has.
    own = "_p" + "_" * max((len(c) for c in docs.columns), default=0)
    return docs.withColumn(own, predict("text")).withColumns({"lang_pred": F.col(f"{own}.lang_pred"), "score": F.col(f"{own}.score")}).drop(own)
