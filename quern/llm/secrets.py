"""Secrets in text: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Fixed patterns find assignments, access keys and long hexadecimal runs.  Besides, every run of 20 or more key
characters is tested as if its characters were drawn evenly from the alphabet of its inferred encoding, the smallest
that has them all: chi-squared of the character counts, and of the counts of vowels, common and rare letters, capitals,
digits and marks; runs of vowels; changes between kinds of characters; the correlation of neighbours.  Fisher's method joins
the p-values; a high one means that nothing tells the run from random.

What a high p-value is worth depends on length and encoding, so the share of false finds is controlled in each length class
of each group of encodings.  Decoys say how ordinary text scores: the short words of every text, put end to end, are
cut from first to last into decoys of each class's length, and written as identifiers are: in one case, with numbers,
with capitals, numbers and separators, or as hexadecimal and decimal codes.  Equal decoys count once over all documents,
so that copies and common headers weigh no more than other text; a sketch for each cell of the histogram estimates how
many there are.  The share of decoys at or above a score is that score's p-value under the hypothesis of text, and the
threshold is the lowest score at which candidates times that p-value are at most `fdr` of the candidates found
(Benjamini and Hochberg's rule).  Both histograms cover all documents and have a fixed number of cells.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ready

# The base patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_MIN, ACCESS_MIN = 6, 20
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WORDISH = re.compile(r"[^\W\d_]+")
# Letters by how often texts in Latin script have them, vowels first.
VOWELS, COMMON, RARE = "eaiou", "nstrldh", "cmpgfbvwykzxjq"
LETTERS, DIGITS = VOWELS + COMMON + RARE, "0123456789"
#: Alphabets in the order in which an encoding is inferred, and their groups: codes, one case, with digits, mixed.
ALPHABETS = (
    (DIGITS, 0), (DIGITS + "abcdef", 0), (DIGITS + "ABCDEF", 0), (LETTERS, 1), (LETTERS.upper(), 1), (LETTERS.upper() + "234567", 2),
    (LETTERS + DIGITS, 2), (LETTERS.upper() + DIGITS, 2), (LETTERS + LETTERS.upper() + DIGITS, 3), (LETTERS + LETTERS.upper() + DIGITS + "+/", 3),
    (LETTERS + LETTERS.upper() + DIGITS + "-_", 3), (LETTERS + LETTERS.upper() + DIGITS + "+/-_", 3),
)
GROUPS = 4
#: Kinds of characters whose shares are tested.
KINDS_OF = (VOWELS, COMMON, RARE, VOWELS.upper(), COMMON.upper(), RARE.upper(), DIGITS, "+/-_")
#: Lower ends of the length classes.
LENGTHS = (20, 24, 28, 32, 48, 96)
CELLS, DECADES = 240, 12.0  # of log10 p
REGISTERS = 1024  # of a sketch: a standard error of 3.3 % for each cell, less for sums


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start and kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


_erfc = np.frompyfunc(math.erfc, 1, 1)


def _two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / math.sqrt(2)).astype(float)


def _chi2_tail(x: np.ndarray, k: int) -> np.ndarray:
    """Upper tail, by Wilson and Hilferty's cube root."""
    d = 2 / (9 * k)
    return np.where(x <= 0, 1.0, 0.5 * _erfc((np.cbrt(np.maximum(x, 0) / k) - (1 - d)) / math.sqrt(2 * d)).astype(float))


class Encoding:
    """The battery for one alphabet."""

    def __init__(self, alphabet: str, group: int):
        self.k, self.group = len(alphabet), group
        self.code = np.zeros(256, np.int64)
        self.code[[ord(c) for c in alphabet]] = np.arange(self.k)
        kinds = [[alphabet.index(c) for c in kind if c in alphabet] for kind in KINDS_OF]
        self.kinds = [np.array(x) for x in kinds if x] if group else []
        self.vowel = np.array([c.lower() in VOWELS for c in alphabet]) if group else np.arange(self.k) >= self.k / 2
        self.sort = np.array([0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in alphabet])
        share = np.bincount(self.sort) / self.k
        self.change = 1 - float((share**2).sum())
        self.change_again = float((share * (1 - share) ** 2).sum())  # of two changes in a row

    def p(self, chars: np.ndarray) -> np.ndarray:
        """The joint p-value of each row of characters (bytes)."""
        x = self.code[chars]
        rows, n = x.shape
        k = self.k
        counts = np.bincount((np.arange(rows)[:, None] * k + x).ravel(), minlength=rows * k).reshape(rows, k)
        ps = [_chi2_tail(((counts - n / k) ** 2).sum(axis=1) * k / n, k - 1)]
        if len(self.kinds) > 1:
            chi = sum((counts[:, kind].sum(axis=1) - len(kind) * n / k) ** 2 / (len(kind) * n / k) for kind in self.kinds)
            ps.append(_chi2_tail(chi, len(self.kinds) - 1))
        high = self.vowel[x]
        up = high.sum(axis=1)
        down = n - up
        runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
        mean = 1 + 2 * up * down / n
        var = np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        ps.append(np.where((up == 0) | (down == 0), 1.0, _two_sided((runs - mean) / np.sqrt(var))))
        if self.change > 0:
            sort = self.sort[x]
            changes = (sort[:, 1:] != sort[:, :-1]).sum(axis=1)
            q = self.change
            var = (n - 1) * q * (1 - q) + 2 * (n - 2) * (self.change_again - q * q)
            ps.append(_two_sided((changes - (n - 1) * q) / math.sqrt(max(var, 1e-9))))
        c = 2 * x - (k - 1)
        serial = np.einsum("ij,ij->i", c[:, 1:], c[:, :-1]) / 4 / ((k * k - 1) / 12 * math.sqrt(n - 1))
        ps.append(_two_sided(serial))
        fisher = -sum(np.log(np.maximum(p, 1e-300)) for p in ps)
        term = out = np.exp(-fisher)
        for i in range(1, len(ps)):
            term = term * fisher / i
            out = out + term
        return out


ENCODINGS = [Encoding(a, g) for a, g in ALPHABETS]
#: Of each byte a bit for every alphabet that has it.
_HAS = np.zeros(256, np.uint16)
for _i, (_a, _) in enumerate(ALPHABETS):
    _HAS[[ord(_c) for _c in _a]] |= np.uint16(1 << _i)


def battery(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joint p-value and group of each row of characters (bytes), rows being of one length; 0 and -1 of no encoding."""
    mask = np.bitwise_and.reduce(_HAS[chars], axis=1).astype(np.int64)
    p, group = np.zeros(len(chars)), np.full(len(chars), -1)
    which = np.where(mask > 0, np.log2(mask & -mask, where=mask > 0, out=np.zeros(len(mask))), -1).astype(np.int64)
    for i in np.unique(which[which >= 0]):
        sel = which == i
        p[sel], group[sel] = ENCODINGS[i].p(chars[sel]), ENCODINGS[i].group
    return p, group


def scores(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """battery of tokens of any lengths; padding at the end is left out.  Under 8 characters say nothing."""
    p, group = np.zeros(len(tokens)), np.full(len(tokens), -1)
    by: dict[int, list[int]] = {}
    plain = [t.rstrip("=") for t in tokens]
    for i, t in enumerate(plain):
        by.setdefault(len(t), []).append(i)
    for n, at in by.items():
        if n >= 8:
            p[at], group[at] = battery(np.frombuffer("".join([plain[i] for i in at]).encode("latin-1"), np.uint8).reshape(len(at), n))
    return p, group


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def cells(p: np.ndarray) -> np.ndarray:
    x = ((np.log10(np.clip(p, 10**-DECADES, 1)) + DECADES) / DECADES * CELLS).astype(np.int64)
    return np.minimum(x, CELLS - 1)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters that no base span touches; base: by start."""
    out, i, reach = [], 0, -1
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while i < len(base) and base[i][0] < b:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= a:
            out.append((a, b))
    return out


def letters(text: str) -> bytes:
    """The text's own short ASCII words, lower-cased but for a capital at the start of each, end to end."""
    return "".join([w.capitalize() for w in WORDISH.findall(text) if len(w) < 20 and w.isascii()]).encode()


def _cut(texts: list[bytes], size: int) -> np.ndarray:
    """Rows of `size` letters: each text cut from its first letter on, and its last `size` letters."""
    n = np.array([len(t) for t in texts], np.int64)
    x = np.frombuffer(b"".join(texts), np.uint8)
    first, times = np.cumsum(n) - n, n // size
    at = np.repeat(first, times) + size * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
    rest = (times > 0) & (n % size > 0)
    at = np.concatenate([at, (first + n - size)[rest]])
    return x[at[:, None] + np.arange(size)] if len(at) else np.zeros((0, size), np.uint8)


def _mixed(h: np.ndarray) -> np.ndarray:
    for mul in (0xD6E8FEB86659FD93, 0xA24BAED4963EE407):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(mul)
    return h ^ (h >> np.uint64(32))


def _hash(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    h = np.zeros(len(x), np.uint64)
    for i, column in enumerate(np.ascontiguousarray(x.T)):
        h += (column.astype(np.uint64) + np.uint64(1)) * _ODD[i]
    return _mixed(h)


_HEX = np.frombuffer(b"0123456789ABCDEF", np.uint8)


def decoys(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `size` characters, the texts' letters written as identifiers are, and a hash of each row's letters.

    Equal letters give equal decoys.
    """
    x = _cut(texts, size)
    h = _hash(x)
    if not len(x):
        return x, h
    style = (h % np.uint64(8)).astype(np.int64)
    low = x | 32
    out = low.copy()
    # Draws for each character, from the hash of its row.
    step = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E6C63D0876A9A47)

    def draws(sel: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            d = (h[sel][:, None] ^ step) * np.uint64(0xDAA66D2C7DDF743F)
            d = (d ^ (d >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (d >> np.uint64(40)).astype(np.uint32)  # 24 bits

    def numbers(y: np.ndarray, s: np.ndarray, d: np.ndarray, share: float, first: int, many: int) -> None:
        """Puts numbers of one to three digits before some of the words."""
        row, at = np.nonzero(s & (d < share * 2**24))
        digits = 1 + d[row, at] % 3
        for back in (1, 2, 3):
            sel = (digits >= back) & (at >= back)
            r, c = row[sel], at[sel] - back
            y[r, c] = first + d[r, c] % many

    for kind in range(2, 8):  # the others stay in lower case
        sel = np.nonzero(style == kind)[0]
        if not len(sel):
            continue
        y = low[sel]
        if kind == 7:  # as codes: hexadecimal, or decimal of three digits
            i = np.arange(size)
            z = 48 + y[:, i // 3].astype(np.int64) // np.array([100, 10, 1])[i % 3] % 10
            y = np.where(i % 2 == 0, _HEX[(y >> 4)[:, i // 2]], _HEX[(y & 15)[:, i // 2]])
            out[sel] = np.where((h[sel] >> np.uint64(8) & np.uint64(1))[:, None] == 1, z.astype(np.uint8), y)
            continue
        s, d = x[sel] < 97, draws(sel)
        if kind in (2, 3):  # with numbers, in digits of base 36 or 32
            numbers(y, s, d, 0.3, *((48, 10) if kind == 2 else (50, 6)))
            if kind == 3:
                y = np.where(y >= 97, y - 32, y)
        else:  # with capitals and numbers, also with separators
            numbers(y, s, d, 0.2, 48, 10)
            if kind < 6:
                y = np.where(s & (d < 0.6 * 2**24), y & 0xDF, y)
            if kind > 4:
                row, at = np.nonzero(s & (d > 0.7 * 2**24))
                y[row, at] = np.frombuffer(b"-_/+", np.uint8)[d[row, at] % 4]
        out[sel] = y
    return out, h


#: Multipliers of the letters of a row's 64-bit hash.
_ODD = np.random.default_rng(26).integers(0, 2**63, max(LENGTHS), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def note(sketch: np.ndarray, group: np.ndarray, cell: np.ndarray, h: np.ndarray) -> None:
    """Enters rows by their hashes in the sketches (GROUPS, CELLS, REGISTERS): equal rows leave the same mark."""
    h = _mixed(h)
    register = (h % np.uint64(REGISTERS)).astype(np.int64)
    rank = 54 - np.frexp((h >> np.uint64(11)).astype(float))[1]  # the first one of 53 bits
    np.maximum.at(sketch, (group, cell, register), rank.astype(np.uint8))


def distinct(registers: np.ndarray) -> int:
    """How many different rows a sketch has seen (HyperLogLog, by linear counting where it has room)."""
    m = len(registers)
    raw = 0.7213 / (1 + 1.079 / m) * m * m / np.exp2(-registers.astype(float)).sum()
    empty = int((registers == 0).sum())
    return round(m * math.log(m / empty) if empty and raw <= 2.5 * m else raw)


def _text(t) -> str:
    return t if isinstance(t, str) else ""


#: Sketches of a cell of so many tasks are united before all are.
TASKS = 1000


def histograms(docs: DataFrame) -> list[tuple[int, int, int, int, int]]:
    """(length class, group, cell, candidates, different decoys) over all documents, at most so many rows as cells."""
    ready(docs.sparkSession)

    def count(frames):
        n = np.zeros((len(LENGTHS), GROUPS, CELLS), np.int64)
        sketch = np.zeros((len(LENGTHS), GROUPS, CELLS, REGISTERS), np.uint8)
        some, size = [], 0

        def enter():
            for c, length in enumerate(LENGTHS):
                x, h = decoys(some, length)
                for at in range(0, len(x), 8192):
                    to = slice(at, at + 8192)
                    p, group = battery(x[to])
                    ok = group >= 0
                    note(sketch[c], group[ok], cells(p[ok]), h[to][ok])

        for f in frames:
            tokens = []
            for t in f["text"]:
                if not (t := _text(t)):
                    continue
                some.append(letters(t))
                size += len(some[-1])
                if size > 500_000:
                    enter()
                    some, size = [], 0
                if CANDIDATE.search(t):
                    tokens += [t[a:b] for a, b in candidates(t, base_spans(t))]
            p, group = scores(tokens)
            ok = group >= 0
            np.add.at(n, (np.array([length_class(len(t)) for t in tokens], int)[ok], group[ok], cells(p[ok])), 1)
        enter()
        c, g, x = np.nonzero((n > 0) | sketch.any(axis=3))
        part = TaskContext.get().partitionId() // TASKS
        yield pd.DataFrame({"c": c, "g": g, "x": x, "part": part, "found": n[c, g, x], "sketch": [zlib.compress(s.tobytes(), 1) for s in sketch[c, g, x]]})

    def united(keys: list[str], last: bool):
        """One row for each key of rows sorted by it: finds summed, sketches united; at last the number that they have seen."""

        def run(frames):
            key, found, every, out = None, 0, None, []

            def told():
                end = distinct(every) if last else zlib.compress(every.tobytes(), 1)
                out.append((*key, found, end))

            for f in frames:
                for *k, n, s in f[[*keys, "found", "sketch"]].itertuples(index=False, name=None):
                    if k != key:
                        if key is not None:
                            told()
                        key, found, every = k, 0, np.zeros(REGISTERS, np.uint8)
                    found += n
                    np.maximum(every, np.frombuffer(zlib.decompress(s), np.uint8), out=every)
            if key is not None:
                told()
            yield pd.DataFrame(out, columns=[*keys, "found", "decoys" if last else "sketch"])

        return run

    sketches = "c long, g long, x long, part long, found long, sketch binary"
    rows = docs.select("text").mapInPandas(count, sketches)
    for keys, last, schema in ((["c", "g", "x", "part"], False, sketches), (["c", "g", "x"], True, "c long, g long, x long, found long, decoys long")):
        rows = rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(united(keys, last), schema)
    return [tuple(r) for r in rows.collect()]


def thresholds(rows: list[tuple[int, int, int, int, int]], fdr: float) -> np.ndarray:
    """For each length class and group the lowest cell that is a find; CELLS where none is."""
    found, decoy = (np.zeros((len(LENGTHS), GROUPS, CELLS)) for _ in range(2))
    for c, g, x, f, d in rows:
        found[c, g, x], decoy[c, g, x] = f, d
    every, all_decoys = found.sum(axis=2, keepdims=True), decoy.sum(axis=2, keepdims=True)
    found, decoy = (x[:, :, ::-1].cumsum(axis=2)[:, :, ::-1] for x in (found, decoy))
    # One decoy more: without many decoys no score is rare enough.
    good = (every * (decoy + 1) / (all_decoys + 1) <= fdr * found) & (found > 0)
    first = np.where(good.any(axis=2), good.argmax(axis=2), CELLS)
    # A floor that true keys pass with probability 0.999: below it the tests themselves speak against random.
    return np.maximum(first, int(cells(np.array([1e-3]))[0]))


def more_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], limits: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """All spans of each text: the base ones and the random ones."""
    owner, spans, tokens = [], [], []
    for i, (t, base) in enumerate(zip(texts, bases)):
        for a, b in candidates(t, base) if CANDIDATE.search(t) else ():
            owner.append(i), spans.append((a, 3, b)), tokens.append(t[a:b])
    out = [list(b) for b in bases]
    p, group = scores(tokens)
    for i, span, token, g, x in zip(owner, spans, tokens, group.tolist(), cells(p).tolist()):
        if g >= 0 and x >= limits[length_class(len(token)), g]:
            out[i].append(span)
    return [sorted(x) for x in out]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCAN = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scanner(limits: np.ndarray, mark: str | None):
    """A column function of a text: the struct SCAN, with the redacted text if there is a mark."""
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    @F.pandas_udf(SCAN if mark is None else SCAN + ", redacted string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        texts = [_text(t) for t in texts]
        bases = [base_spans(t) for t in texts]
        out = []
        for t, base, spans in zip(texts, bases, more_spans(texts, bases, limits)):
            n = [sum(k == i for _, k, _ in base) for i in range(3)]
            row = (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))
            out.append(row if mark is None else (*row, redact(t, spans, mark)))
        return pd.DataFrame(out, columns=names if mark is None else [*names, "redacted"])

    return scan


def scan_secrets(docs: DataFrame, fdr: float = 0.01, mark: str | None = "[secret]", text: str = "text", out: str = "scan") -> DataFrame:
    """docs with the struct column `out`: counts and digest of the base spans, all spans, and the text without them.

    Spans are kind:start:end in code points, end exclusive.  A null text counts as empty (its redacted form too);
    empty tables give no rows; repeated rows are scanned alike; a column named like `out` is replaced, other columns
    stay as they are.  Overlapping spans become one mark in the redacted text, which is left out if `mark` is None.
    Two passes over the texts, no shuffle but of the histograms.
    """
    limits = thresholds(histograms(docs.select(F.col(text).alias("text"))), fdr)
    column: Column = scanner(limits, mark)(F.col(text))
    return docs.withColumn(out, column)
