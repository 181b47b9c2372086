"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

All ways to cut a text into pieces form a lattice.  A piece of rank r weighs (r + RANK0) ^ -alpha, after Zipf's law
(the vocabulary is of the merge kind and has ranks, no probabilities), and a segmentation weighs the product of its
pieces.  The forward pass sums the weights of all ways to each place, the backward pass draws pieces from the end
with probability in proportion, so that each segmentation is drawn exactly by its weight.  Each draw is a hash
of the row's key and the place in the text: the same row gives the same pieces on any machine, in any batch and order.

No piece reaches over certain pairs of characters (before a space mark, around a line break, before a stop after a
letter), so the lattice falls apart into words.  Both passes run over the words of a batch side by side: step k is
the k-th place of every word; the forward pass takes equal words once.  Characters of no piece become their bytes.  The literal mark U+2581 is spelled by
bytes, so decoding gives back every text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ready

MARK = "▁"  # stands for a space in pieces
LITERAL = 0x110000  # stands for the literal U+2581 in the lattice; beyond all code points
RANK0 = 50.0
#: Letters before which and characters after which the lattice falls apart, if the vocabulary allows it.
LETTERS = ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F))
STOPS = ".,!?;:|*#$%&\"()"
DENSE = 256  # characters with a column in the transition table
LONG = 48  # words of more characters are filtered one by one, in scaled numbers
BATCH = 100_000  # characters whose lattices are in memory at a time
LIFT = 64.0  # a factor for each character that keeps forward sums in range


class Lattice:
    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
        self.pieces = {sp.id_to_piece(i): i for i in plain}
        self.longest = max(map(len, self.pieces))
        self.weight = np.zeros(n)
        for i in plain:
            self.weight[i] = (rank[i] + RANK0) ** -alpha
        self.byte_weight = (n + RANK0) ** -alpha
        self.surface: dict[int, bytes] = {i: sp.id_to_piece(i).replace(MARK, " ").encode() for i in plain} | {i: bytes([b]) for b, i in self.byte.items()}
        pairs = {x for p in self.pieces for x in zip(p, p[1:])}
        if any(b == MARK and a != MARK or "\n" in (a, b) for a, b in pairs):
            raise ValueError("pieces reach over space marks or line breaks")
        self.letter = np.zeros(0x10000, bool)
        for a, b in LETTERS:
            self.letter[a : b + 1] = True
        self.stop = np.zeros(0x10000, bool)
        for c in STOPS:
            self.stop[ord(c)] = not any(b == c and self.letter[min(ord(a), 0xFFFF)] for a, b in pairs)
        self._grow()

    def _grow(self) -> None:
        """The trie of the pieces: a dense table for frequent characters, sorted keys for the others."""
        often: dict[str, int] = {}
        for p in self.pieces:
            for c in p:
                often[c] = often.get(c, 0) + 1
        chars = sorted(often, key=lambda c: (-often[c], c))
        self.number = np.full(LITERAL + 1, -1, np.int32)
        for i, c in enumerate(chars):
            self.number[ord(c)] = i
        number, next_, piece = {c: i for i, c in enumerate(chars)}, [{}], [-1]
        for p, i in self.pieces.items():
            at = 0
            for c in p:
                k = number[c]
                if k not in next_[at]:
                    next_[at][k] = len(next_)
                    next_.append({})
                    piece.append(-1)
                at = next_[at][k]
            piece[at] = i
        self.piece = np.array(piece, np.int32)
        self.dense = np.full((len(next_), DENSE), -1, np.int32)
        keys, to = [], []
        for at, row in enumerate(next_):
            for k, t in row.items():
                if k < DENSE:
                    self.dense[at, k] = t
                else:
                    keys.append(at * 0x10000 + k)
                    to.append(t)
        order = np.argsort(keys) if keys else np.zeros(0, int)
        self.keys, self.to = np.array(keys, np.int64)[order], np.array(to, np.int32)[order]

    def _step(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where characters lead from trie nodes, -1 for nowhere."""
        out = np.full(len(node), -1, np.int32)
        common = (c >= 0) & (c < DENSE)
        if common.all():
            return self.dense[node, c]
        out[common] = self.dense[node[common], c[common]]
        rare = np.nonzero(c >= DENSE)[0]
        if len(rare) and len(self.keys):
            key = node[rare].astype(np.int64) * 0x10000 + c[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[rare[hit]] = self.to[at[hit]]
        return out

    def sample_batch(self, texts: list[str], seeds: list[int]) -> list[np.ndarray]:
        """The ids of one segmentation of each text; none for an empty text."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= BATCH):
                size += len(texts[to]) + 1
                to += 1
            out += self._sampled(texts[at:to], seeds[at:to])
            at = to
        return out

    def sample(self, text: str, seed: int) -> list[int]:
        return self._sampled([text], [seed])[0].tolist()

    def _sampled(self, texts: list[str], seeds: list[int]) -> list[np.ndarray]:
        lengths = np.array([len(t) + 1 if t else 0 for t in texts])
        cp = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        n = len(cp)
        if not n:
            return [np.zeros(0, np.int64) for _ in texts]
        literal = cp == ord(MARK)
        cp[cp == 32] = ord(MARK)
        cp[literal] = LITERAL
        base = np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(len(texts)), lengths)

        # Where words begin.
        small = np.minimum(cp, 0xFFFF)
        begin = np.zeros(n + 1, bool)
        begin[base[lengths > 0]] = begin[n] = True
        mark, line, letter = cp == ord(MARK), cp == 10, self.letter[small]
        begin[1:n] |= mark[1:] & ~mark[:-1] | line[1:] | line[:-1] | self.stop[small][1:] & letter[:-1]
        first = np.nonzero(begin)[0]
        size = np.diff(first)
        first = first[:-1]

        # Equal words have equal lattices: c0, where a word's lattice is, instead of where the word is.
        kind, rep = _distinct_words(cp, first, size)
        sizes = size[rep]
        starts = np.cumsum(sizes) - sizes
        words = cp[np.repeat(first[rep] - starts, sizes) + np.arange(int(sizes.sum()))]
        weight, ids, spelled = self._lattices(words, starts, sizes)
        single_file = (sizes > LONG) | spelled & (sizes > 12)
        table = self._forward(weight, starts, np.where(single_file, 0, sizes))

        drawn = np.zeros(n + 1, np.int64)  # at the end of a drawn piece its id, shifted by one; below 0 for bytes
        for i in np.nonzero(single_file[kind])[0]:
            self._one(int(starts[kind[i]]), int(size[i]), weight, ids, drawn, int(first[i]), seeds[doc[first[i]]], int(base[doc[first[i]]]))
        side = np.nonzero(~single_file[kind])[0]
        seed = np.array([s & (2**64 - 1) for s in seeds], np.uint64)
        f0, c0, k = first[side], starts[kind[side]], size[side].copy()
        owner = doc[f0]
        word_seed, origin = seed[owner], base[owner]
        row = kind[side]
        deep = len(weight)
        while len(k):
            j = c0 + k
            u = _uniform(word_seed, (f0 + k - origin).astype(np.uint64))
            # Sums are kept by place: what a place has is what all ways to it weigh.
            aim = np.minimum(u * table[k, row], np.nextafter(table[k, row], 0))
            total, l, open_ = np.zeros(len(k)), np.zeros(len(k), np.int64), np.ones(len(k), bool)
            for i in range(min(deep, int(k.max()))):
                total = total + np.where(k > i, weight[i, j] * table[np.maximum(k - i - 1, 0), row], 0.0)
                hit = open_ & (total > aim)
                l[hit] = i
                open_ &= ~hit
                if not open_.any():
                    break
            x = ids[l, j].astype(np.int64)
            drawn[f0 + k] = np.where(x >= 0, x + 1, x)
            k = k - l - 1
            go = k > 0
            if not go.all():
                k, f0, c0, row, word_seed, origin = k[go], f0[go], c0[go], row[go], word_seed[go], origin[go]

        hit = np.nonzero(drawn)[0]
        values, owner = drawn[hit], doc[hit - 1]
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        out = []
        for i in range(len(texts)):
            v = values[bounds[i] : bounds[i + 1]]
            if (v < 0).any():
                every: list[int] = []
                for x in v.tolist():
                    if x > 0:
                        every.append(x - 1)
                    else:
                        ch = MARK if -1 - x == LITERAL else chr(-1 - x)
                        every += [self.byte[b] for b in ch.encode("utf-8", "surrogatepass")]
                out.append(np.array(every, np.int64))
            else:
                out.append(v - 1)
        return out

    def _lattices(self, cp: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces by their length and end: weight (0 for none) and id of the piece of length l + 1 that ends before
        place j, and whether a word has characters that are spelled by bytes."""
        n = len(cp)
        end = np.repeat(first + size, size)
        deep = min(self.longest, int(size.max()))
        weight = np.zeros((deep, n + 1))
        ids = np.zeros((deep, n + 1), np.int32)
        c = self.number[cp]
        p, node, single, reach = np.arange(n), np.zeros(n, np.int32), np.zeros(n, bool), 1
        for l in range(deep):
            node = self._step(node, c[p + l])
            go = node >= 0
            p, node = p[go], node[go]
            got = self.piece[node]
            has = got >= 0
            q, g = p[has], got[has]
            reach = l + 1 if len(q) else reach
            weight[l, q + l + 1] = self.weight[g] * LIFT ** (l + 1)
            ids[l, q + l + 1] = g
            if l == 0:
                single[q] = True
            more = p + l + 1 < end[p]
            p, node = p[more], node[more]
            if not len(p):
                break
        alone = np.nonzero(~single)[0]
        spelled = np.zeros(len(first), bool)
        if len(alone):
            x = cp[alone]
            width = np.where(x < 0x80, 1, np.where(x < 0x800, 2, np.where((x < 0x10000) | (x == LITERAL), 3, 4)))
            weight[0, alone + 1] = self.byte_weight**width * LIFT
            ids[0, alone + 1] = -1 - x
            spelled[np.searchsorted(first, alone, side="right") - 1] = True
        return weight[:reach], ids[:reach], spelled

    def _forward(self, weight: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(place, word): the weight of all ways to each place of each word.

        Terms are added in one order whatever the batch, so the sums are the same to the last bit.
        """
        table = np.zeros((int(size.max()) + 1, len(first)))
        table[0] = 1.0
        side = np.argsort(-size, kind="stable")
        live = np.searchsorted(-size[side], -np.arange(1, len(table)), side="right")
        sorted_ = np.zeros_like(table)
        sorted_[0] = 1.0
        at = first[side]
        for k in range(1, len(table)):
            m = live[k - 1]
            j = at[:m] + k
            total = weight[0, j] * sorted_[k - 1, :m]
            for l in range(1, min(k, len(weight))):
                total = total + weight[l, j] * sorted_[k - l - 1, :m]
            sorted_[k, :m] = total
        table[:, side] = sorted_
        return table

    def _one(self, at: int, n: int, weight, ids, drawn, place: int, seed: int, base: int) -> None:
        """The passes over one long word; sums are scaled as they go, only the ratios of neighbours matter.

        at: where its lattice is; place: where the word is.
        """
        deep = len(weight)
        f = [1.0] + [0.0] * n
        shares: list = [None] * (n + 1)
        for k in range(1, n + 1):
            w = min(k, deep)
            cum = np.cumsum(weight[:w, at + k] * np.array(f[k - 1 : k - w - 1 if k > w else None : -1]))
            total = float(cum[-1])
            shares[k] = cum / total
            f[k] = total
            if not 1e-100 < total < 1e100:
                for i in range(max(0, k - self.longest), k + 1):
                    f[i] /= total
        k = n
        while k:
            u = float(_uniform(np.array([seed & (2**64 - 1)], np.uint64), np.array([place + k - base], np.uint64))[0])
            l = int((shares[k] <= min(u, np.nextafter(shares[k][-1], 0))).sum())
            x = int(ids[l, at + k])
            drawn[place + k] = x + 1 if x >= 0 else x
            k -= l + 1

    def decode(self, ids) -> str:
        """The text whose pieces these are."""
        surface = self.surface
        raw = b"".join([surface[i] for i in ids])
        return raw[1:].decode("utf-8", "surrogatepass") if raw else ""


def _distinct_words(cp: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word's kind, equal words being of one kind, and a word of each kind."""
    within = np.arange(len(cp)) - np.repeat(first, size)
    x = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E6C63D0876A9A47) ^ within.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    for shift in (31, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xDAA66D2C7DDF743F)
    x ^= x >> np.uint64(32)
    word = np.add.reduceat(x, first) + size.astype(np.uint64)
    _, rep, kind = np.unique(word, return_index=True, return_inverse=True)
    # Equal sums of other words: none is expected in 10^9 batches, and each word stands for itself then.
    same = size[rep][kind] == size
    if same.all():
        same = cp == cp[np.repeat(first[rep][kind], size) + within]
    return (kind, rep) if same.all() else (np.arange(len(first)), np.arange(len(first)))


def _uniform(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each seed and place."""
    x = seed ^ (place * np.uint64(0xD1342543DE82EF95) + np.uint64(0x632BE59BD9B4E019))
    for shift, factor in ((32, 0xDAA66D2C7DDF743F), (29, 0x9E6C63D0876A9A47), (32, 0xDAA66D2C7DDF743F)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) * 2.0**-53


_LATTICES: dict[tuple, Lattice] = {}


def lattice(path: str, alpha: float) -> Lattice:
    """One for each Python worker and parameters."""
    if (path, alpha) not in _LATTICES:
        _LATTICES[path, alpha] = Lattice(path, alpha)
    return _LATTICES[path, alpha]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def row_seed(key, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{seed}:{key}".encode())


def encode_sampled(df: DataFrame, key: str, text: str = "text", seed: int = 1, alpha: float = 1.0, path: str | None = None) -> DataFrame:
    """df with the column `pieces`: the ids of one sampled segmentation of each text.

    Null texts have null pieces, empty ones none.  Rows with the same key and text get the same pieces, a null key
    being a key of its own; empty tables give no rows; other columns stay.  Larger alpha favours frequent pieces.
    """
    ready(df.sparkSession)
    path = path or vocabulary()

    @F.pandas_udf("array<int>")
    def encode(keys: pd.Series, texts: pd.Series) -> pd.Series:
        lat = lattice(path, alpha)
        got = lat.sample_batch([t if isinstance(t, str) else "" for t in texts], [row_seed(k, seed) for k in keys])
        return pd.Series([g if isinstance(t, str) else None for g, t in zip(got, texts)], dtype=object)

    return df.withColumn("pieces", encode(F.col(key).cast("string"), F.col(text)))


def decode_pieces(df: DataFrame, pieces: str = "pieces", out: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the text that the pieces spell: null for null, empty for none."""
    ready(df.sparkSession)
    path = path or vocabulary()

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        lat = lattice(path, 1.0)
        return pd.Series([None if x is None else lat.decode(x.tolist() if hasattr(x, "tolist") else x) for x in ids], dtype=object)

    return df.withColumn(out, decode(F.col(pieces)))


def encoded_digest(df: DataFrame, key: str, text: str = "text", seed: int = 1, alpha: float = 1.0, path: str | None = None) -> DataFrame:
    """key, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), n_chars, lossless: encoding and decoding in one pass.

    A null text counts as empty here.
    """
    ready(df.sparkSession)
    path = path or vocabulary()

    @F.pandas_udf("n_pieces long, ids_crc32 long, n_chars long, lossless boolean")
    def digest(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        lat, out = lattice(path, alpha), []
        texts = [t if isinstance(t, str) else "" for t in texts]
        for t, ids in zip(texts, lat.sample_batch(texts, [row_seed(k, seed) for k in keys])):
            out.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(t), lat.decode(ids.tolist()) == t))
        return pd.DataFrame(out, columns=["n_pieces", "ids_crc32", "n_chars", "lossless"])

    return df.select(key, digest(F.col(key).cast("string"), F.col(text)).alias("d")).select(key, "d.*")
