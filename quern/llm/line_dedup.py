"""Repeated lines across documents, by levelled sorted runs of line hashes.

A run holds (a, b, n, hi): a 128-bit key of a line, how many documents hold it, and the largest doc_id among them,
in buckets of the key, each one sorted file: two runs are merged as they lie, without a shuffle or a sort.  Each new batch of documents is merge-anti-joined with the runs: keys that no run holds are new and
enter the levels as a run of level 0; keys that a run holds already raise that key's count, in a run of raises beside
the levels.  `fanout` runs of a level are merged into one run of the next (n is summed, hi the maximum), so that a key
is rewritten once per level and a look-up reads few runs.  Once no batch is left everything is merged by key.

DataFrame operations alone: no Python runs on the executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import SPACE, ascii_lower, forget, key128, scratch, written

#: Keys so frequent that one task should not have all their lines; more than that many can't each hold a larger
#: share of the lines than 1 / HOT, so the list's size is bounded whatever the corpus.
HOT = 2000
RUN = "a long, b long, n long, hi long"


def _keys(text, min_chars: int):
    """An element for each line: its key, null where the line is too short to count."""
    trimmed = F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)))
    return F.transform(trimmed, lambda x: F.when(F.char_length(x) >= min_chars, key128(x)))


def held(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, a, b): each key of a document once."""
    keys = F.array_distinct(F.filter(_keys(F.coalesce("text", F.lit("")), min_chars), lambda x: x.isNotNull()))
    return docs.select("doc_id", F.explode(keys).alias("k")).select("doc_id", "k.a", "k.b")


#: A bucket of a run is one file, so that Spark may rely on its order.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def save_run(run: DataFrame, buckets: int, *partitions: str, dealt: bool = True) -> str:
    """Writes (a, b, ...) in buckets sorted by key, in the shared folder; the name of a table of this session's catalog.

    dealt: whether the rows of a bucket are in one task already, as after a shuffle by key or a join of runs.
    """
    name, path = f"quern_run_{uuid.uuid4().hex}", scratch(run.sparkSession, "run")
    run = run if dealt else run.repartition(buckets, "a", "b")
    out = run.write.bucketBy(buckets, "a", "b").sortBy("a", "b").option("path", path).format("parquet")
    (out.partitionBy(*partitions) if partitions else out).saveAsTable(name)
    return name


class LineRuns:
    """The levels of new keys, and the levels of raises: for each, the tables of its runs.

    All runs have as many buckets as the session has shuffle partitions when the first is made, so what a shuffle by key
    deals out is a bucket already.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.raises: list[list[str]] = []
        self.before = spark.conf.get(ORDERED, None)
        spark.conf.set(ORDERED, "true")

    def _runs(self) -> list[str]:
        return [x for levels in (self.levels, self.raises) for level in levels for x in level]

    def rows(self) -> DataFrame:
        """All runs as one, merged by key."""
        runs = self._runs()
        return self._merged(runs) if runs else self.spark.createDataFrame([], RUN)

    def _merged(self, runs: list[str]) -> DataFrame:
        """Runs merged as they lie: n is summed, hi the maximum."""
        out = self.spark.table(runs[0])
        for x in runs[1:]:
            other = self.spark.table(x).toDF("a2", "b2", "n2", "hi2")
            both = out.hint("merge").join(other.hint("merge"), (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")), "full_outer")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))
            out = both.select(F.coalesce("a", "a2").alias("a"), F.coalesce("b", "b2").alias("b"), n.alias("n"), F.greatest("hi", "hi2").alias("hi"))
        return out

    def drop(self, run: str) -> None:
        path = self.spark.sql(f"DESCRIBE FORMATTED {run}").where("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"DROP TABLE {run}")
        forget(self.spark, path)

    def forget(self) -> None:
        for x in self._runs():
            self.drop(x)
        self.levels, self.raises = [], []
        self.spark.conf.unset(ORDERED) if self.before is None else self.spark.conf.set(ORDERED, self.before)

    def new_keys(self, run: DataFrame) -> DataFrame:
        """The rows of a batch's run whose key no run holds yet: one merge-anti-join a run, bucket by bucket."""
        for level in self.levels:
            for x in level:
                run = _anti(run, self.spark.table(x))
        return run

    def add(self, run: DataFrame) -> str:
        """Adds a batch's run, read from its buckets: returns the run of what was new in it."""
        new = save_run(self.new_keys(run), self.buckets, dealt=bool(self.levels))
        # What is not new raises counts.
        known = save_run(_anti(run, self.spark.table(new)), self.buckets) if self.levels else None
        self._enter(self.levels, new)
        if known:
            self._enter(self.raises, known)
        return new

    def _enter(self, levels: list[list[str]], run: str, level: int = 0) -> None:
        """Adds a written run, then merges levels that are full."""
        while len(levels) <= level:
            levels.append([])
        levels[level].append(run)
        if len(levels[level]) >= self.fanout:
            old = levels[level]
            merged = save_run(self._merged(old), self.buckets)
            levels[level] = []
            for x in old:
                self.drop(x)
            self._enter(levels, merged, level + 1)


def _run(lines: DataFrame) -> DataFrame:
    return lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("hi"))


def _anti(run: DataFrame, other: DataFrame) -> DataFrame:
    return run.hint("merge").join(other.select("a", "b").hint("merge"), ["a", "b"], "left_anti")


def first_seen(runs: LineRuns, batch: DataFrame, min_chars: int = 20) -> DataFrame:
    """Incremental use: (doc_id, a, b) of the batch whose key no earlier batch held; the batch is then added.

    Within the batch a new key belongs to its largest doc_id.
    """
    whole = save_run(_run(held(batch, min_chars)), runs.buckets)
    run = runs.spark.table(whole)
    kept = written(runs.new_keys(run).select(F.col("hi").alias("doc_id"), "a", "b"), "new")
    runs.add(run)
    runs.drop(whole)
    return kept


def dedup_rows(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 5, fanout: int = 2) -> DataFrame:
    """Drops the lines whose key `min_docs` documents or more hold, except in the largest doc_id that holds it.

    docs: doc_id, text and any others; returns docs with left_text (what is left), n_lines and n_dropped.
    A line's key is the line without ASCII white space at its ends, A-Z lower-cased; lines whose key has fewer than
    min_chars code points always stay.  Null and empty texts are one empty line.  Each row is a document, so a row
    repeated three times holds its lines three times; rows that share the largest doc_id all keep the line, and a
    null doc_id is smaller than any other.  An empty table gives no rows; other columns stay,
    but for such named like the three or with a leading _ld_.

    One pass hashes the lines and writes the batches' runs; each is anti-joined with the levels and added to them; the
    other pass looks each document's keys up among the merged runs' common ones.  The shuffles carry hashes, and the
    texts once, to meet their verdicts.
    """
    spark = docs.sparkSession
    docs = docs.drop("left_text", "n_lines", "n_dropped", "_ld_id", "_ld_lost", "_ld_left")
    lines = held(docs, min_chars)

    # A batch is what one slice of the documents brings; one shuffle by key writes the buckets of all, which are added one by one.
    runs = LineRuns(spark, fanout)
    slice_ = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    each = [x for i in range(batches) for x in (F.count_if(slice_ == i).alias(f"n{i}"), F.max(F.when(slice_ == i, F.col("doc_id"))).alias(f"hi{i}"))]
    every = F.array(*(F.struct(F.lit(i).alias("batch"), F.col(f"n{i}").alias("n"), F.col(f"hi{i}").cast("long").alias("hi")) for i in range(batches)))
    sliced = lines.groupBy("a", "b").agg(*each).select("a", "b", F.inline(every)).where("n > 0")
    base = save_run(sliced, runs.buckets, "batch")
    for i in range(batches):
        runs.add(spark.table(base).where(F.col("batch") == i).select("a", "b", "n", "hi"))
    runs.drop(base)
    common = written(runs.rows().where(F.col("n") >= min_docs), "common")
    runs.forget()

    # The few most frequent keys are broadcast, HOT rows at most; the rest are joined by key, where none is hot.
    hot = common.orderBy(F.desc("n"), "a", "b").limit(HOT).select("a", "b", F.col("hi").alias("hot_hi"))
    rest = common.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti").select(F.col("a").alias("ra"), F.col("b").alias("rb"), "hi")
    told = lines.join(F.broadcast(hot), ["a", "b"], "left")
    # Lines that are settled already are spread by document, not by their frequent key.
    settled = F.col("hot_hi").isNotNull()
    told = told.withColumn("ja", F.when(settled, F.xxhash64("doc_id", "a")).otherwise(F.col("a"))).withColumn("jb", F.when(settled, F.lit(None).cast("long")).otherwise(F.col("b")))
    told = told.join(rest, (told["ja"] == rest["ra"]) & told["jb"].eqNullSafe(rest["rb"]), "left")
    best = F.coalesce("hot_hi", "hi")
    losing = told.where(best.isNotNull() & ~F.col("doc_id").eqNullSafe(best)).select(F.col("doc_id").alias("_ld_id"), F.struct("a", "b").alias("k"))
    losing = losing.groupBy("_ld_id").agg(F.collect_set("k").alias("_ld_lost"))

    joined = docs.join(losing, docs["doc_id"].eqNullSafe(losing["_ld_id"]), "left")
    text = F.coalesce("text", F.lit(""))
    # Documents that lose nothing need no keys again.
    zipped = F.arrays_zip(F.split(text, "\n", -1).alias("line"), _keys(text, min_chars).alias("k"))
    left = F.when(F.col("_ld_lost").isNull(), F.split(text, "\n", -1)).otherwise(
        F.transform(F.filter(zipped, lambda x: x["k"].isNull() | ~F.array_contains(F.col("_ld_lost"), x["k"])), lambda x: x["line"])
    )
    out = joined.withColumns({"_ld_left": left, "n_lines": F.size(F.split(text, "\n", -1)).cast("long")})
    out = out.withColumns({"left_text": F.array_join("_ld_left", "\n"), "n_dropped": (F.col("n_lines") - F.size("_ld_left")).cast("long")})
    return out.drop("_ld_id", "_ld_lost", "_ld_left")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """dedup_rows for doc_id and text alone: doc_id, text (what is left), n_lines, n_dropped."""
    out = dedup_rows(docs.select("doc_id", "text"), min_chars, min_docs)
    return out.select("doc_id", F.col("left_text").alias("text"), "n_lines", "n_dropped")
