"""Vector bin packing of examples into fixed-length training sequences.

An example has a demand in three dimensions: tokens, segments and loss-bearing tokens.  A sequence is a bin with
a limit in each.  The bin-centric dot-product heuristic fills one bin at a time: among the examples of a bounded
window that fit, it takes the one whose demand has the largest dot product with what the bin has left, each
dimension divided by its limit.  Big demands go where there is room for them, and a scarce dimension counts little.

Every partition packs its own rows as they stream by, so nothing is shuffled and memory is bounded by the window.  A
lost task is packed again alike if its rows come in the same order, as they do from files; after a shuffle, sort the
partitions first where sequence ids must not change.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import known_ids, ready


@dataclass(frozen=True)
class Limits:
    """Of one sequence: tokens, segments, loss-bearing tokens."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], float)


class Window:
    """Examples that wait for a place: demands in one array, what they stand for beside it."""

    def __init__(self, limits: Limits, size: int):
        self.limit = limits.vector()
        self.demand = np.zeros((size, 3))
        self.what: list = [None] * size
        self.n = 0

    def full(self) -> bool:
        return self.n == len(self.what)

    def add(self, demand: tuple, what) -> None:
        self.demand[self.n] = demand
        self.what[self.n] = what
        self.n += 1

    def best(self, left: np.ndarray) -> int:
        """The fitting example with the largest dot product of demand and room, or -1; ties go to the oldest."""
        d = self.demand[: self.n]
        fits = (d <= left).all(axis=1)
        if not fits.any():
            return -1
        score = d @ (left / self.limit**2)
        score[~fits] = -1.0
        return int(score.argmax())

    def take(self, i: int):
        what, demand = self.what[i], self.demand[i].copy()
        self.n -= 1
        self.what[i], self.what[self.n] = self.what[self.n], None
        self.demand[i] = self.demand[self.n]
        return what, demand


def pack_stream(examples: Iterable[tuple[tuple, object]], limits: Limits, window: int, cut=None) -> Iterator[tuple[int, list]]:
    """Yields (bin number, [(what, offset in tokens)]) for examples ((tokens, segments, loss), what).

    cut(what, tokens) -> (head, head's demand, tail, tail's demand) splits an example; with it, a bin that nothing
    fits any more is filled to the last token.  Without it the bin closes with what it has.  An example above a
    limit by itself gets a bin of its own (it can't be split without cut) rather than being dropped.
    """
    limit = limits.vector()
    wait = Window(limits, window)
    source, more, number = iter(examples), True, 0

    def refill() -> None:
        nonlocal more
        while more and not wait.full():
            got = next(source, None)
            if got is None:
                more = False
            else:
                wait.add(*got)

    refill()
    while wait.n:
        left, placed, used = limit.copy(), [], 0
        while wait.n and left[0] > 0:
            i = wait.best(left)
            if i >= 0:
                what, demand = wait.take(i)
                placed.append((what, used))
            elif cut is not None and (left >= 1).all():
                i = int(wait.demand[: wait.n, 0].argmax())
                what, _ = wait.take(i)
                head, demand, tail, rest = cut(what, int(min(left[0], left[2])))
                placed.append((head, used))
                wait.add(rest, tail)
            elif not placed:
                what, demand = wait.take(0)
                placed.append((what, 0))
            else:
                break
            left = left - demand
            used += int(demand[0])
            refill()
        yield number, placed
        number += 1


def powers(n: int) -> list[int]:
    """n as a sum of distinct powers of two, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_examples(df: DataFrame, key: str, tokens: str, segments: str, loss: str, limits: Limits = Limits(), window: int = 1024) -> DataFrame:
    """Whole instruction examples into sequences: key, sequence_id, offset, and the three demands as given.

    Null demands count as 0, a null key is a key; an example beyond a limit has a sequence of its own; ties and repeated rows are
    separate examples; an empty table gives no rows.  Columns other than the four named ones are left out.
    """
    ready(df.sparkSession)
    src = df.select(F.col(key).cast("string").alias("key"), *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(n) for n, c in (("tokens", tokens), ("segments", segments), ("loss", loss))), F.spark_partition_id().alias("part"))

    def run(frames):
        part = 0

        def examples():
            nonlocal part
            for f in frames:
                if len(f):
                    part = int(f["part"].iloc[0])
                for k, a, b, c in zip(f["key"], f["tokens"], f["segments"], f["loss"]):
                    yield (a, b, c), (k, a, b, c)

        out = []
        for number, placed in pack_stream(examples(), limits, window):
            out += [(*what, (part << 33) | number, at) for what, at in placed]
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=["key", "tokens", "segments", "loss", "sequence_id", "offset"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["key", "tokens", "segments", "loss", "sequence_id", "offset"])

    kind = dict(df.dtypes)[key]
    out = src.mapInPandas(run, "key string, tokens long, segments long, loss long, sequence_id long, offset long")
    return out.select(F.col("key").cast(kind).alias(key), "tokens", "segments", "loss", "sequence_id", "offset")


def pack_conversations(turns: DataFrame, limits: Limits = Limits(2048, 16, 1024), window: int = 1024, path: str | None = None) -> DataFrame:
    """Whole conversations (conv_id, turn, role, text) into sequences: the rows of pack_examples, one for each.

    A turn is a segment of its ids and the end id, of which the assistant's bear loss.  Null texts are empty, null and
    other roles bear no loss, a null conv_id is a conversation of its own; an empty table gives no rows; other columns
    are left out.  Rows are sorted by conv_id within each partition, so that a lost task is packed again alike.
    """
    ready(turns.sparkSession)
    path = path or vocabulary()

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        ids = coder(path)
        return pd.Series([len(ids(t if isinstance(t, str) else "")) for t in texts], dtype="int64")

    n = turns.select("conv_id", "role", count("text").alias("n"))
    loss = F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0))
    each = n.groupBy("conv_id").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("segments"), loss.alias("loss"))
    return pack_examples(each.sortWithinPartitions("conv_id"), "conv_id", "tokens", "segments", "loss", limits, window)


#: One piece of a document in a sequence.
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END = 1  # the id that ends a document
#: The tokens that the tokenizers file adds to the vocabulary, which its rank file leaves out.
ADDED = {"<|endoftext|>": 50256}


def token_ids(path: str, added: dict[str, int] | None = None):
    """text -> little-endian unsigned 32-bit ids, END last.

    The tiktoken form of the same byte-level vocabulary gives the ids that tokenizers gives, five times as fast;
    tests hold one against the other.  A string of `added` is one id, as with the file's default settings; without
    `added` such strings are ordinary text.
    """
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {})
    end = np.array([END], "<u4")

    def ids(text: str) -> np.ndarray:
        if not text:
            return end
        # Bytes that are no UTF-8 reach Python as lone surrogates at worst; they become U+FFFD as in Arrow.
        return np.concatenate([encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False), end])

    return ids


_CODERS: dict[str, object] = {}


def coder(path: str):
    """One coder for each Python worker."""
    if path not in _CODERS:
        _CODERS[path] = token_ids(path, ADDED)
    return _CODERS[path]


def vocabulary() -> str:
    """The public byte-level vocabulary's file, in its tiktoken form."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pack_documents(docs: DataFrame, limits: Limits = Limits(), window: int = 256, path: str | None = None) -> DataFrame:
    """Documents (doc_id, text) cut and packed into sequences; one row for each piece.

    The part of a document that fills whole sequences is cut off first, each such piece being a sequence; the rests
    are packed by the dot-product heuristic, with the piece that would overflow cut where a sequence is full.  Of
    each partition's last, part-filled sequence the pieces are dealt out once more into sequences whose lengths are
    powers of two, so that no id is padding.

    A sequence holds limits.segments pieces at most (256 unless told otherwise), so very short documents leave room.
    Null and empty texts are documents of the end id alone; null doc_ids stay null; repeated rows are documents of
    their own; an empty table gives no rows; other columns are left out.  Memory holds `window` rests of a document.
    """
    ready(docs.sparkSession)
    path = path or vocabulary()
    src = known_ids(docs, "text", F.spark_partition_id().alias("part"))
    size = min(limits.tokens, limits.loss)

    def run(frames):
        ids_of, part, whole = coder(path), 0, []

        def piece(doc, start, ids, total):
            return doc, start, len(ids), zlib.crc32(ids.tobytes()), total

        def rests():
            nonlocal part
            for f in frames:
                if len(f):
                    part = int(f["part"].iloc[0])
                for doc, known, text in zip(f["doc_id"].tolist(), f["known"].tolist(), f["text"]):
                    doc = doc if known else None
                    ids = ids_of(text)
                    n = len(ids)
                    for at in range(0, n - size + 1, size):
                        whole.append(piece(doc, at, ids[at : at + size], n))
                    at = n - n % size
                    if at < n:
                        yield (n - at, 1, n - at), (doc, at, ids[at:].copy(), n)

        def cut(what, tokens):
            doc, at, ids, n = what
            rest = len(ids) - tokens
            return (doc, at, ids[:tokens], n), (tokens, 1, tokens), (doc, at + tokens, ids[tokens:], n), (rest, 1, rest)

        def frame(rows):
            f = pd.DataFrame([r[1:] for r in rows], columns=["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            f.insert(0, "doc_id", pd.array([r[0] for r in rows], "Int64"))
            return f

        out, number = [], 0

        def sequence(members):
            nonlocal number
            out.extend((*m, (part << 33) | number, at) for m, at in members)
            number += 1

        for _, placed in pack_stream(rests(), limits, window, cut):
            used = placed[-1][1] + len(placed[-1][0][2])
            if used == size:
                sequence([(piece(*what), at) for what, at in placed])
            else:
                todo = [what for what, _ in placed]
                for length in powers(used):
                    members, at = [], 0
                    while at < length:
                        what = todo.pop(0)
                        if len(what[2]) > length - at:
                            what, _, tail, _ = cut(what, length - at)
                            todo.insert(0, tail)
                        members.append((piece(*what), at))
                        at += len(what[2])
                    sequence(members)
            for w in whole:
                sequence([(w, 0)])
            whole.clear()
            if len(out) >= 20_000:
                yield frame(out)
                out.clear()
        for w in whole:
            sequence([(w, 0)])
        if out:
            yield frame(out)

    return src.mapInPandas(run, PIECE)
