"""Comparison of query results: multiset and ordered equality with numeric tolerance, permutations, votes.

A verification's results are bounded by the limits on rows, size and time, and are compared on the executors, by signatures
and, where those leave it open, as rows.  Many results at
once are compared in one plan, each pair of results in its own group.  Frames of any size are equal if each has nothing
that the other has not; only what is left of both, bounded likewise, is paired within the tolerance.
"""

from __future__ import annotations

import json
import math
import re
import threading
from bisect import bisect_left, bisect_right
from collections import Counter, OrderedDict, defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date
from decimal import Decimal
from functools import lru_cache, partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.limits import Limits
from quern.plans.gate import Gate, GateError, Result
from quern.session import ready, shared_folder

REL, ABS = 1e-6, 1e-9
#: Rows that whole_tasks puts together at least, where there are as many; orders of columns that are told by signatures.
TOGETHER, TRIED = 10_000, 64
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def is_number(kind: str) -> bool:
    return kind.startswith(NUMERIC)


def plain(df: DataFrame) -> DataFrame:
    """Columns named c0, c1, ... by position; numbers as doubles, nested values as JSON."""
    df = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    cast = []
    for c, kind in df.dtypes:
        if is_number(kind):
            cast.append(F.col(c).cast("double").alias(c))
        elif kind.startswith(("array", "map", "struct")):
            cast.append(F.to_json(c).alias(c))
        else:
            cast.append(F.col(c).cast("string").alias(c) if kind == "void" else F.col(c))
    return df.select(*cast)


def comparable(a: DataFrame, b: DataFrame) -> bool:
    """Whether each pair of columns is of one class: numbers, or the same type."""
    return all(x == y or "void" in (x, y) for (_, x), (_, y) in zip(plain(a).dtypes, plain(b).dtypes))


def _value(v):
    """Numbers as floats, other values as (class, value); null stays."""
    if v is None or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
        return "NaN" if v != v else float(v)  # NaN equals itself
    if isinstance(v, (list, tuple, dict)):
        v = json.dumps(v, default=str, sort_keys=True)
    return type(v).__name__ if not isinstance(v, date) else "time", v


def value_equal(a, b) -> bool:
    """Null equals null alone, numbers within a relative 1e-6 or absolute 1e-9, other values their equals of the same class."""
    a, b = _value(a), _value(b)
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=REL, abs_tol=ABS)
    return a == b


def row_equal(a, b) -> bool:
    """Whether rows have equal values place by place; names of columns don't matter."""
    return len(a) == len(b) and all(map(value_equal, a, b))


def _paired(left: Counter, right: Counter) -> bool:
    """Whether each row of numbers, as often as it occurs, has a partner of its own within the tolerance.

    Equal rows are partners at first; the others find theirs along alternating paths, so a perfect matching is found
    if there is one.  The column of most different values is swept for the partners that come into question.
    """
    if left.total() != right.total():
        return False
    lack, spare = left - right, right - left
    if not lack:
        return True
    width = range(len(next(iter(lack))))
    if not width:
        return False
    by = max(width, key=lambda c: len({r[c] for r in right}))
    order = sorted(right, key=lambda r: r[by])
    at = [r[by] for r in order]
    known: dict[tuple, list[tuple]] = {}

    def fits(x: tuple) -> list[tuple]:
        if x not in known:
            slack = 2 * max(REL * abs(x[by]), ABS)
            some = order[bisect_left(at, x[by] - slack) : bisect_right(at, x[by] + slack)]
            known[x] = [r for r in some if all(math.isclose(x[c], r[c], rel_tol=REL, abs_tol=ABS) for c in width)]
        return known[x]

    flow: dict[tuple, Counter] = defaultdict(Counter)  # of each right row, from which left rows and how often
    for r in left.keys() & right.keys():
        flow[r][r] = min(left[r], right[r])
    for start, n in lack.items():
        while n:
            came: dict[tuple, tuple] = {}  # right row: the left row it was reached from
            via: dict[tuple, tuple] = {}  # left row: the right row that it has so far
            layer, end = [start], None
            while layer and end is None:
                after = []
                for x in layer:
                    for r in fits(x):
                        if r in came:
                            continue
                        came[r] = x
                        if spare[r] > 0:
                            end = r
                            break
                        for y, f in flow[r].items():
                            if f > 0 and y != start and y not in via:
                                via[y] = r
                                after.append(y)
                    if end is not None:
                        break
                layer = after
            if end is None:
                return False
            path, r = [], end
            while True:
                x = came[r]
                path.append((x, r))
                if x == start:
                    break
                r = via[x]
            much = min([n, spare[end], *(flow[via[x]][x] for x, _ in path if x != start)])
            for x, r in path:
                flow[r][x] += much
                if x != start:
                    flow[via[x]][x] -= much
            spare[end] -= much
            n -= much
    return True


def rows_equal(left: list, right: list, ordered: bool = False) -> bool:
    """Whether two results are equal as lists, or as multisets, by a perfect matching."""
    if len(left) != len(right):
        return False
    if ordered:
        return all(map(row_equal, left, right))
    groups: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    for side, rows in enumerate((left, right)):
        for row, n in Counter(tuple(map(_value, r)) for r in rows).items():
            # What must be equal, with the places of the numbers, and the numbers.
            exact = tuple("number" if isinstance(v, float) else ("exact", v) for v in row)
            groups[exact][side][tuple(v for v in row if isinstance(v, float))] += n
    return all(_paired(*g) for g in groups.values())


def unordered_equal(a: DataFrame, b: DataFrame, limit: int = Limits.verifier_rows) -> bool:
    """Multiset equality with tolerance, for frames of any size.

    Equal rows cancel out; of the others at most `limit` on each side are paired, more raise result_too_large.
    """
    if len(a.columns) != len(b.columns) or not comparable(a, b):
        return False
    a, b = plain(a), plain(b)
    left, right = (x.limit(limit + 1).collect() for x in (a.exceptAll(b), b.exceptAll(a)))
    if max(len(left), len(right)) > limit:
        raise GateError("result_too_large")
    return rows_equal([tuple(r) for r in left], [tuple(r) for r in right])


def ordered_equal(a: DataFrame, b: DataFrame, limit: int = Limits.verifier_rows) -> bool:
    """Equality row by row in the results' order, of at most `limit` rows; more raise result_too_large."""
    if len(a.columns) != len(b.columns) or not comparable(a, b):
        return False
    left, right = (plain(x).limit(limit + 1).collect() for x in (a, b))
    if max(len(left), len(right)) > limit:
        raise GateError("result_too_large")
    return rows_equal([tuple(r) for r in left], [tuple(r) for r in right], ordered=True)


def _parts(kind: str, c: Column) -> tuple[Column, Column | None]:
    """What of a value must be equal, as text that does not run into its neighbour's, and the number that may be a little off."""
    if is_number(kind):
        d = c.cast("double")
        return F.when(c.isNull(), "0").when(F.isnan(d), "n").otherwise("1"), F.when(F.isnan(d) | c.isNull(), 0.0).otherwise(d)
    if kind.startswith(("array", "map", "struct")):
        kind, c = "j", F.to_json(c)
    elif kind == "binary":
        c = F.hex(c)
    kind = "time" if kind.startswith("timestamp") else kind
    return F.coalesce(F.concat(F.lit(kind), F.char_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("0")), None


def _close(a: np.ndarray, b: np.ndarray, times: int = 1) -> np.ndarray:
    """math.isclose of arrays without NaN, or with a tolerance some times as wide."""
    with np.errstate(invalid="ignore", over="ignore"):
        off = np.abs(a - b)
        return (a == b) | (np.isfinite(off) & (off <= times * np.maximum(REL * np.maximum(np.abs(a), np.abs(b)), ABS)))


def _judged(task: np.ndarray, side: np.ndarray, exact: np.ndarray, numbers: list[np.ndarray], ordered: bool) -> tuple[np.ndarray, np.ndarray]:
    """(first rows of the tasks, equal) of rows that are sorted by task, side and order or values; all but a few tasks at once.

    Sorted multisets that agree row by row are equal.  Those whose exact parts don't agree, or of which some column, sorted by
    itself, does not, are not.  Only the others are paired, task by task.
    """
    starts = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
    group = np.cumsum(np.append(True, task[1:] != task[:-1])) - 1
    many = len(starts)
    count = [np.bincount(group[side == s], minlength=many) for s in (0, 1)]
    even = count[0] == count[1]
    # Both sides of a task have as many rows, so that the i-th left row of all is at the place of the i-th right one.
    l, r = (np.flatnonzero(even[group] & (side == s)) for s in (0, 1))

    def told(good: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.bincount(group[at[~good]], minlength=many) == 0

    same = told(exact[l] == exact[r], l)
    near = np.ones(len(l), bool)
    for x in numbers:
        near &= _close(x[l], x[r])
    near = told(near, l)
    equal = even & same & near
    if ordered or not numbers:
        return starts, equal
    open_ = even & same & ~near & (count[0] > 1)
    for x in numbers:
        some = np.flatnonzero(open_[group])
        some = some[np.lexsort((x[some], exact[some], side[some], group[some]))]
        a, b = some[side[some] == 0], some[side[some] == 1]
        open_ &= told(_close(x[a], x[b], 2), a)
    for g in np.flatnonzero(open_):
        found: dict[int, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        for i in range(starts[g], starts[g] + 2 * count[0][g]):
            found[exact[i]][side[i]][tuple(float(x[i]) for x in numbers)] += 1
        equal[g] = all(_paired(*p) for p in found.values())
    return starts, equal


def whole_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole tasks with a number for each row's task, of batches that are sorted by their first column, the task."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < TOGETHER or held[0][0][0] == b[0][b.num_rows - 1]:
            continue  # few rows, or one task so far
        rows = pa.Table.from_batches(held).combine_chunks()
        task = rows[0].chunk(0).dictionary_encode("encode").indices.to_numpy()
        last = int(np.flatnonzero(np.append(True, task[1:] != task[:-1]))[-1])
        if last:
            yield rows.slice(0, last), task[:last]
        held, size = rows.slice(last).to_batches(), len(rows) - last
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, rows[0].chunk(0).dictionary_encode("encode").indices.to_numpy()


def results_equal(left: DataFrame, right: DataFrame, task: str, order: str | None = None) -> DataFrame:
    """(task, equal) for many pairs of results in one plan; each row of left and right is a row of its task's result.

    With `order`, a column that numbers the rows, results are lists; else multisets.  Columns compare by position.  A result that
    one side lacks is empty there; null tasks are a task.  Rows of both sides are sorted by task and stream through Python, where the
    tasks of a batch are compared together.  Memory holds a batch and one pair of results, whose sizes the limits of their
    executions bound.
    """
    ready(left.sparkSession)
    columns = [[c for c in x.columns if c not in (task, order)] for x in (left, right)]
    if len(columns[0]) != len(columns[1]):
        return left.select(task).union(right.select(task)).distinct().withColumn("equal", F.lit(False))
    parts = [[_parts(dict(x.dtypes)[c], F.col(c)) for c in cs] for x, cs in zip((left, right), columns)]
    at = [i for i, (a, b) in enumerate(zip(*parts)) if a[1] is not None or b[1] is not None]

    def side(n: int, x: DataFrame) -> DataFrame:
        exact = F.concat(F.lit(""), *(e for e, _ in parts[n])).alias("exact")
        numbers = [(F.lit(0.0) if parts[n][i][1] is None else parts[n][i][1]).alias(f"n{i}") for i in at]
        return x.select(F.col(task).alias("task"), F.lit(n).alias("side"), exact, *numbers, *([F.col(order).alias("place")] if order else []))

    def compare(batches):
        for rows, number in whole_tasks(batches):
            exact = rows["exact"].chunk(0).dictionary_encode().indices.to_numpy()
            starts, equal = _judged(number, rows["side"].to_numpy(), exact, [rows[f"n{i}"].to_numpy() for i in at], order is not None)
            yield pa.RecordBatch.from_arrays([rows["task"].chunk(0).take(pa.array(starts)), pa.array(equal)], ["task", "equal"])

    both = side(0, left).union(side(1, right))
    by = [F.asc_nulls_last("place")] if order else ["exact", *(f"n{i}" for i in at)]
    out = both.repartition("task").sortWithinPartitions("task", "side", *by).drop("place")
    return out.mapInArrow(compare, f"task {dict(both.dtypes)['task']}, equal boolean").withColumnRenamed("task", task)


@dataclass
class Verdict:
    correct: bool = False
    valid: bool = False
    executable: bool = False
    column_match: bool = False
    row_match: bool = False
    value_match: bool = False
    order_sensitive: bool = False
    error: str | None = None

    @property
    def reward(self) -> float:
        return float(self.correct)


def _run(gate: Gate, sql: str) -> Result:
    """A query's whole result within the verifier's limits; GateError beyond them."""
    x = gate.limits
    got = gate.execute(sql, rows=x.verifier_rows, size=x.verifier_bytes, seconds=x.verifier_seconds)
    if got.has_more:
        raise GateError("result_too_large")
    return got


@dataclass
class Summary:
    """What is told of a result where it lies: its number of rows and two sums of hashes of them, whatever their order."""

    df: DataFrame  # columns c0, c1, ...
    rows: int
    marks: tuple[int, int]

    @property
    def numbers(self) -> list[bool]:
        return [is_number(kind) for _, kind in self.df.dtypes]


def _summary(gate: Gate, sql: str) -> Summary:
    """A query run within the verifier's limits, of which one row comes to the driver; GateError beyond them."""
    x, df = gate.limits, gate.dataframe(sql)
    df = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    values = [v for c, kind in df.dtypes for v in _parts(kind, F.col(c))]
    values = [F.lit(0.0) if v is None else v for v in values]
    marks = [F.coalesce(F.sum(F.pmod(F.xxhash64(F.lit(salt), *values), F.lit(1 << 32))), F.lit(0)) for salt in ("a", "b")]
    size = [F.coalesce(F.char_length((F.to_json(c) if kind.startswith(("array", "map", "struct")) else F.col(c)).cast("string")), F.lit(0)).cast("long") for c, kind in df.dtypes]
    total = F.coalesce(F.sum(reduce(lambda a, b: a + b, size)), F.lit(0))
    rows, a, b, size = gate.collect(df.agg(F.count(F.lit(1)), *marks, total), x.verifier_seconds)[0]
    if rows > x.verifier_rows or size > x.verifier_bytes:
        raise GateError("result_too_large")
    return Summary(df, rows, (a, b))


def _agree(gate: Gate, got: Summary, want: Summary, ordered: bool) -> bool:
    """Whether results of as many rows and columns are equal.

    Marks tell equal multisets (64 bits), and different ones where no number may be a little off; what they leave open is
    told by rows, which meet in a task, within the limits.
    """
    if got.marks == want.marks and (not ordered or got.rows < 2):
        return True
    if got.marks != want.marks and not any(a and b for a, b in zip(got.numbers, want.numbers)):
        return False
    # Ids grow in the order of a sorted frame.
    sides = [x.df.withColumns({"task": F.lit(0), **({"place": F.monotonically_increasing_id()} if ordered else {})}) for x in (got, want)]
    told = gate.collect(results_equal(*sides, "task", "place" if ordered else None), 2 * gate.limits.verifier_seconds)
    return all(r["equal"] for r in told)


def verify(gate: Gate, candidate: str, reference: str, want: Callable[[], Summary] | None = None) -> Verdict:
    """Validate, resolve and run the candidate, then compare columns, rows and values in turn.

    The reference's outermost ORDER BY makes order count.  Each side runs within the limits on rows, size and time, and stays
    on the executors: the driver gets a summary of it; where that leaves it open whether values agree, both run once more
    and meet there.  The same text as the reference's runs once in all.  `want` gives the reference's summary where it is known.
    """
    v = Verdict()
    try:
        gate.validate(candidate)
        v.valid = True
        got = _summary(gate, candidate)
        v.executable = True
    except GateError as e:
        v.error = e.kind
        return v
    v.order_sensitive = gate.ordered(reference)
    want = got if candidate == reference else want() if want else _summary(gate, reference)
    v.column_match = len(got.df.columns) == len(want.df.columns)
    v.row_match = v.column_match and got.rows == want.rows
    try:
        v.value_match = v.row_match and (got is want or _agree(gate, got, want, v.order_sensitive))
    except GateError as e:
        v.error = e.kind
        return v
    v.correct = v.value_match
    v.error = None if v.correct else "wrong_result"
    return v


def side_by_side(spark: SparkSession, work: Iterable[Callable], at_once: int = 8, pool: str = "verification") -> Iterator:
    """What each callable returns, in order; at most `at_once` run at a time, in a pool of the fair scheduler.

    Callables are taken from the iterable as threads come free, and results handed on as they are asked for, so that the driver
    holds a few of either.  An exception is raised at its place.
    """

    def one(f):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        return f()

    work = iter(work)
    with ThreadPoolExecutor(at_once) as threads:
        begun: deque = deque()
        while True:
            while len(begun) < 2 * at_once and (f := next(work, None)) is not None:
                begun.append(threads.submit(inheritable_thread_target(spark)(one), f))
            if not begun:
                return
            yield begun.popleft().result()


class _Shared:
    """Summaries of references that several candidates have: run once, kept for the last few."""

    def __init__(self, gate: Gate, kept: int):
        self.gate, self.kept, self.lock = gate, kept, threading.Lock()
        self.results: OrderedDict[str, list] = OrderedDict()

    def __call__(self, sql: str) -> Summary:
        with self.lock:
            slot = self.results.setdefault(sql, [threading.Lock(), None])
            self.results.move_to_end(sql)
            while len(self.results) > self.kept:
                self.results.popitem(last=False)
        with slot[0]:
            if slot[1] is None:
                try:
                    slot[1] = _summary(self.gate, sql)
                except GateError as e:
                    slot[1] = e
        if isinstance(slot[1], GateError):
            raise slot[1]
        return slot[1]


def verify_many(gate: Gate, pairs: Iterable[tuple], at_once: int = 8) -> Iterator[tuple]:
    """(key, verdict) of each (key, candidate, reference), in order, several side by side.

    Each execution has the limits to itself, time included.  A reference is run once for candidates that follow one another; where
    it fails the verdict's error is reference_ and its class.
    """
    shared = _Shared(gate, 2 * at_once)

    def one(key, candidate, reference):
        try:
            return key, verify(gate, candidate, reference, lambda: shared(reference))
        except GateError as e:  # verify handles the candidate's own
            return key, Verdict(valid=True, executable=True, error=f"reference_{e.kind}")

    return side_by_side(gate.spark, (partial(one, *p) for p in pairs), at_once)


VERDICTS = "correct boolean, valid boolean, executable boolean, column_match boolean, row_match boolean, value_match boolean, order_sensitive boolean, error string"


def verify_table(gate: Gate, pairs: DataFrame, key: str = "id", candidate: str = "candidate", reference: str = "reference", at_once: int = 8, chunk: int = 5_000) -> DataFrame:
    """(key, the fields of a verdict) for a table of pairs, which streams through the driver; verdicts are written in chunks.

    Queries are the driver's to start and Spark's to run; results stay on the executors, bounded by the limits.  A null candidate is an empty one.
    """
    spark, names = ready(gate.spark), VERDICTS.replace(" boolean", "").replace(" string", "").split(", ")
    schema, path, rows = f"{key} {dict(pairs.dtypes)[key]}, {VERDICTS}", shared_folder(spark, "verdicts"), []

    def keep() -> None:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        rows.clear()

    streamed = pairs.select(key, candidate, reference).orderBy(reference).toLocalIterator()
    for k, v in verify_many(gate, ((r[0], r[1] or "", r[2] or "") for r in streamed), at_once):
        rows.append((k, *(getattr(v, n) for n in names)))
        if len(rows) >= chunk:
            keep()
    keep()
    return spark.read.schema(schema).parquet(path)


def permuted_equal(left: list, right: list, ordered: bool = False) -> bool:
    """Whether some order of the columns of `right` makes it equal to `left`.

    Columns fit where their values are equal, pairs of columns where their pairs of values are; only orders of which all
    pairs fit are tried, column by column, and given up once the rows so far differ.
    """
    if len(left) != len(right):
        return False
    if not left:
        return True
    if len(left[0]) != len(right[0]):
        return False
    width = len(left[0])
    part = lambda rows, cs: [tuple(r[c] for c in cs) for r in rows]
    fits = [{j for j in range(width) if rows_equal(part(left, [i]), part(right, [j]), ordered)} for i in range(width)]
    first = sorted(range(width), key=lambda i: (len(fits[i]), i))

    @lru_cache(None)
    def together(i: int, j: int, i2: int, j2: int) -> bool:
        return rows_equal(part(left, [i, i2]), part(right, [j, j2]), ordered)

    if math.prod(map(len, fits)) > width:  # else there is little to try
        changed = True
        while changed:
            changed = False
            for i in range(width):
                for i2 in range(width):
                    if i != i2:
                        keep = {j for j in fits[i] if any(j != j2 and together(i, j, i2, j2) for j2 in fits[i2])}
                        changed |= keep != fits[i]
                        fits[i] = keep

    def place(k: int, chosen: list[int]) -> bool:
        if k == width:
            return True
        i = first[k]
        for j in sorted(fits[i]):
            if j not in chosen and all(together(i, j, i2, j2) for i2, j2 in zip(first, chosen)):
                now = [*chosen, j]
                if rows_equal(part(left, first[: k + 1]), part(right, now), ordered) and place(k + 1, now):
                    return True
        return False

    return place(0, [])


def exact_text(kind: str, c: Column) -> Column:
    """A value as text that equal values share: numbers of any type by their exact value, nulls as null."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return c.cast("string")
    if kind.startswith("decimal"):
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if kind in ("float", "double"):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 2.0**63)
        return F.when(whole, F.floor(d).cast("string")).otherwise(F.concat(F.lit("d"), d.cast("string")))
    if kind.startswith(("array", "map", "struct")):
        return F.concat(F.lit("j"), F.to_json(c))
    return F.concat(F.lit("n"), c.cast("string")) if kind != "void" else c.cast("string")


def permuted_results(left: DataFrame, right: DataFrame, task: str) -> DataFrame:
    """(task, equal) for many pairs of results at once: whether some order of right's columns gives left's rows, as multisets.

    left and right: task and the result's columns, a row a row of a result; both have as many columns.  Values are equal as exact
    values.  In one plan each column of each result gets a signature, number of rows and sums of hashes; results without
    a place for some column are told apart by that.  The others are compared by signatures of whole rows, two independent sums of 32-bit
    hashes, in each order that their columns' places allow; only those with more than TRIED choices of places meet as rows, which
    stream sorted by task, pair by pair, within the limits of their executions.  A result that one side lacks is empty; null tasks are a task.
    """
    ready(left.sparkSession)
    columns = {s: [c for c in x.columns if c != task] for s, x in (("l", left), ("r", right))}
    width = len(columns["l"])
    if width != len(columns["r"]):
        tasks = left.select(task).union(right.select(task)).distinct()
        return tasks.withColumn("equal", F.lit(False))
    names = [f"c{i}" for i in range(width)]
    text = {s: x.select(F.col(task).alias("task"), *(exact_text(dict(x.dtypes)[c], F.col(c)).alias(n) for c, n in zip(columns[s], names))) for s, x in (("l", left), ("r", right))}

    # Sums modulo 2^32 of two hashes: exact in a long for any number of rows that a count can hold.
    def marks(*c: str) -> list[Column]:
        return [F.sum(F.pmod(F.xxhash64(F.lit(salt), *(F.coalesce(F.col(x), F.lit("\0")) for x in c)), F.lit(1 << 32))) for salt in ("a", "b")]

    def signed(s: str) -> DataFrame:
        each = F.array(*(F.struct(*marks(n)) for n in names))
        return text[s].groupBy("task").agg(F.count(F.lit(1)).alias(f"{s}n"), each.alias(s)).withColumnRenamed("task", f"{s}task")

    both = signed("l").join(signed("r"), F.col("ltask").eqNullSafe(F.col("rtask")), "full_outer")
    both = both.withColumn("task", F.when(F.col("ln").isNotNull(), F.col("ltask")).otherwise(F.col("rtask")))
    fits = F.transform("l", lambda x: F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.col("r")[j] == x))
    both = both.select("task", (F.col("ln") == F.col("rn")).alias("same"), fits.alias("fits"))
    possible = F.coalesce(F.col("same"), F.lit(False)) & F.forall("fits", lambda x: F.size(x) > 0)
    choices = F.aggregate("fits", F.lit(1).cast("long"), lambda n, x: F.least(n * F.size(x), F.lit(TRIED + 1).cast("long")))
    # Every order that gives each column one of its places, a place once.
    orders = F.aggregate(
        "fits", F.array(F.array().cast("array<int>")),
        lambda some, x: F.flatten(F.transform(some, lambda o: F.transform(F.filter(x, lambda j: ~F.array_contains(o, j)), lambda j: F.array_append(o, j)))),
    )
    few = choices <= TRIED
    stands = both.select("task", F.when(~possible, "differs").when(few, "few").otherwise("many").alias("stands"), F.when(possible & few, orders).alias("orders"))
    path = shared_folder(left.sparkSession, "stands")
    stands.write.parquet(path)
    stands = left.sparkSession.read.schema(stands.schema).parquet(path)
    differs = stands.where("stands = 'differs'").select("task", F.lit(False).alias("equal"))

    def held(s: str, kind: str) -> DataFrame:
        some = stands.where(F.col("stands") == kind).select(F.col("task").alias("_t"), "orders")
        return text[s].join(some, F.col("task").eqNullSafe(F.col("_t"))).drop("_t")

    turned = held("r", "few").select("task", *names, F.posexplode("orders").alias("o", "order"))
    turned = turned.select("task", "o", *(F.array(*names)[F.col("order")[i]].alias(f"c{i}") for i in range(width)))
    want = text["l"].groupBy("task").agg(F.struct(*marks(*names)).alias("l")).withColumnRenamed("task", "ltask")
    tried = turned.groupBy("task", "o").agg(F.struct(*marks(*names)).alias("r")).groupBy("task").agg(F.collect_set("r").alias("r"))
    one = stands.where("stands = 'few'").select(F.col("task").alias("_t")).join(tried, F.col("task").eqNullSafe(F.col("_t")), "left")
    one = one.join(want, F.col("_t").eqNullSafe(F.col("ltask"))).select(F.col("_t").alias("task"), F.coalesce(F.array_contains("r", F.col("l")), F.lit(False)).alias("equal"))

    def compare(batches):
        for rows, number in whole_tasks(batches):
            starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            side, values = rows["side"].to_pylist(), list(zip(*(rows[n].to_pylist() for n in names)))
            equal = []
            for a, b in zip(starts, [*starts[1:], len(side)]):
                equal.append(permuted_equal(*([values[i] for i in range(a, b) if side[i] == s] for s in (0, 1))))
            yield pa.RecordBatch.from_arrays([rows["task"].chunk(0).take(pa.array(starts)), pa.array(equal)], ["task", "equal"])

    rows = [held(s, "many").select("task", F.lit(i).alias("side"), *names) for i, s in enumerate("lr")]
    rows = rows[0].union(rows[1]).repartition("task").sortWithinPartitions("task", "side")
    several = rows.mapInArrow(compare, f"task {dict(rows.dtypes)['task']}, equal boolean")
    return differs.union(one).union(several).withColumnRenamed("task", task)


def permutation_equal(a: DataFrame, b: DataFrame, ordered: bool = False, limit: int = Limits.verifier_rows) -> bool:
    """permuted_equal of two frames of at most `limit` rows; more raise result_too_large."""
    if len(a.columns) != len(b.columns):
        return False
    left, right = ([tuple(r) for r in plain(x).limit(limit + 1).collect()] for x in (a, b))
    if max(len(left), len(right)) > limit:
        raise GateError("result_too_large")
    return permuted_equal(left, right, ordered)


def loosened(sql: str, keep_distinct: bool = False) -> str:
    """Benchmark text fixes: comparison operators joined, DISTINCT dropped, the current year pinned to 2020."""
    sql = re.sub(r"([<>!])\s+=", r"\1=", sql)
    sql = re.sub(r"year\s*\(\s*curdate\s*\(\s*\)\s*\)", "2020", sql, flags=re.I)
    return sql if keep_distinct else re.sub(r"\bdistinct\b", "", sql, flags=re.I)


def equal_everywhere(gates: list[Gate], candidate: str, reference: str, keep_distinct: bool = False, at_once: int = 8) -> bool:
    """Whether candidate and reference agree, up to column order, on every database; several databases side by side."""
    a, b = loosened(candidate, keep_distinct), loosened(reference, keep_distinct)

    def same(gate: Gate) -> bool:
        try:
            want, got = _run(gate, b), _run(gate, a)
        except GateError:
            return False
        return len(want.columns) == len(got.columns) and permuted_equal(want.rows, got.rows, "order by" in reference.lower())

    return all(list(side_by_side(gates[0].spark, (partial(same, g) for g in gates), at_once))) if gates else True


def set_mark(df: DataFrame) -> DataFrame:
    """One row with a mark of the result's set of rows: duplicates and order do not count, numbers do by their exact value."""
    df = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    rows = df.select(*(exact_text(kind, F.col(c)).alias(c) for c, kind in df.dtypes)).distinct()
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.pmod(F.xxhash64(*(F.coalesce(F.col(c), F.lit("\0")) for c in rows.columns)), F.lit(1 << 40))), F.lit(0)).alias("mark"), F.lit(len(rows.columns)).alias("width"))


def vote(candidates: DataFrame, task: str, index: str, mark: str) -> DataFrame:
    """For each task the winner: the largest group of equal marks, ties to the group seen first, its earliest sample.

    Rows without a mark did not execute.  valid is how many did; a task without any has a null winner.
    """
    groups = candidates.groupBy(task, mark).agg(F.count(F.lit(1)).alias("votes"), F.min(index).alias("selected_sample"))
    valid = F.coalesce(F.sum(F.when(F.col(mark).isNotNull(), F.col("votes"))).over(Window.partitionBy(task)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(task).orderBy(F.col(mark).isNull(), F.desc("votes"), "selected_sample"))
    out = groups.withColumns({"valid": valid, "_r": rank}).where("_r = 1")
    none = F.col(mark).isNull()
    return out.select(task, F.when(~none, F.col("selected_sample")).alias("selected_sample"), F.when(none, 0).otherwise(F.col("votes")).alias("votes"), "valid", F.when(none, "all_invalid").otherwise("voted").alias("status"))


def vote_sql(gate: Gate, candidates: list[str | None]) -> dict:
    """The vote over the candidates of one task, each executed once."""
    marks = []
    for i, sql in enumerate(candidates):
        try:
            if sql:
                marks.append(set_mark(gate.dataframe(sql)).select(F.lit(i).alias("sample"), F.concat_ws(":", "width", "n", "mark").alias("mark")))
                continue
        except GateError:
            pass
        marks.append(gate.spark.createDataFrame([(i, None)], "sample int, mark string"))
    rows = marks[0]
    for m in marks[1:]:
        rows = rows.unionByName(m)
    return vote(rows.withColumn("task", F.lit(0)), "task", "sample", "mark").drop("task").first().asDict()


def voting_summary(votes: DataFrame, task: str, correct: str, index: str, selected: str) -> DataFrame:
    """One row: accuracy of the winners, of the first samples, and of an oracle that picks any right sample."""
    per = votes.groupBy(task).agg(
        F.max(F.when(F.col(index) == F.col(selected), F.col(correct).cast("int"))).alias("w"), F.max_by(F.col(correct).cast("int"), -F.col(index)).alias("f"), F.max(F.col(correct).cast("int")).alias("a")
    )
    return per.agg(F.count(F.lit(1)).alias("tasks"), F.avg(F.coalesce("w", F.lit(0))).alias("accuracy"), F.avg(F.coalesce("f", F.lit(0))).alias("first_sample"), F.avg(F.coalesce("a", F.lit(0))).alias("any_sample"))


def vote_tasks(candidates: DataFrame, task: str, index: str, mark: str, correct: str) -> DataFrame:
    """The vote of each task with whether its winner is right: a task without a valid candidate is all_invalid and wrong."""
    won = vote(candidates, task, index, mark)
    told = candidates.select(F.col(task).alias("_t"), F.col(index).alias("_i"), F.col(correct).alias("_c"))
    out = won.join(told, (won[task] == F.col("_t")) & (won["selected_sample"] == F.col("_i")), "left")
    return out.select(task, "selected_sample", "votes", "valid", "status", F.coalesce("_c", F.lit(False)).alias("correct"))


def reference_errors(gate: Gate, tasks: Iterable[tuple], chars: int = 512, at_once: int = 8) -> Iterator[tuple]:
    """(id, error class, message of at most `chars`) for reference queries (id, sql), in order, several side by side.

    Each runs within the verifier's limits.  Tasks with an error are routed out before a split.
    """

    def one(key, sql):
        try:
            _run(gate, sql)
            return key, None, None
        except GateError as e:
            return key, e.kind, str(e)[:chars]

    return side_by_side(gate.spark, (partial(one, *t) for t in tasks), at_once)


def matching_prefix(saved: DataFrame, replayed: DataFrame, episode: str, turn: str, observation: str) -> DataFrame:
    """(episode, turns, matching, complete): how many leading turns of a replay show what the saved record shows.

    A turn that the replay lacks does not match; further ones of the replay don't count.
    """
    got = replayed.select(F.col(episode).alias("_e"), F.col(turn).alias("_t"), F.col(observation).alias("_o"), F.lit(True).alias("_has"))
    both = saved.select(episode, turn, observation).join(got, (F.col(episode) == F.col("_e")) & (F.col(turn) == F.col("_t")), "left")
    same = F.col("_has").isNotNull() & F.col(observation).eqNullSafe(F.col("_o"))
    per = both.withColumn("_same", same).groupBy(episode).agg(F.count(F.lit(1)).alias("turns"), F.min(F.when(~F.col("_same"), F.col(turn))).alias("_bad"), F.array_sort(F.collect_list(turn)).alias("_turns"))
    matching = F.when(F.col("_bad").isNull(), F.col("turns")).otherwise(F.size(F.filter("_turns", lambda x: x < F.col("_bad"))))
    return per.select(episode, "turns", matching.cast("long").alias("matching"), F.col("_bad").isNull().alias("complete"))
