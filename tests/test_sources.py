"""The store's versions with writers at once, and lines of JSON by their numbers."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.sources import jsonl, memory_store
from quern.streaming.incremental import append_new

FIELDS = {"question": "q", "experience": "e", "sql_before": "a", "sql_first_execute": None, "sql_after": "b", "source_split": "train", "initial_record_path": "i", "retry_record_path": "r"}


def memories(spark, ids):
    rows = [dict(FIELDS, source_task_id=str(i)) for i in ids]
    return memory_store.memory_id(spark.createDataFrame(rows, ", ".join(f"{k} string" for k in (*FIELDS, "source_task_id"))))


def test_writers_at_once_leave_each_id_once_and_no_gaps(spark, tmp_path):
    path, told, failed = str(tmp_path / "store"), [], []

    def write(lo):
        try:
            told.append(memory_store.append_verified(spark, path, memories(spark, range(lo, lo + 12))))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(lo,)) for lo in (0, 6, 12, 6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sum(told) == 24
    rows = memory_store.read(spark, path).collect()
    assert sorted(r["seq"] for r in rows) == list(range(1, 25)) and len({r["memory_id"] for r in rows}) == 24
    last = memory_store.version(spark, path)
    assert last == sum(n > 0 for n in told) and len(list(Path(path, "data").iterdir())) == last  # a writer that lost left nothing
    assert not [p for p in Path(path, "log").iterdir() if p.name.startswith("_")]


def test_a_version_stays_what_it_was(spark, tmp_path):
    path = str(tmp_path / "store")
    memory_store.append_verified(spark, path, memories(spark, range(5)))
    snapshot = memory_store.version(spark, path)
    memory_store.append_verified(spark, path, memories(spark, range(3, 9)))
    assert memory_store.read(spark, path, snapshot).count() == 5 and memory_store.read(spark, path).count() == 9
    assert memory_store.read(spark, path, 0).count() == 0 and memory_store.version(spark, str(tmp_path / "none")) == 0
    with pytest.raises(memory_store.Conflict):
        memory_store._publish(spark, path, snapshot, {"folders": [], "last": 0})
    assert memory_store.append_verified(spark, path, memories(spark, range(9))) == 0 and memory_store.version(spark, path) == 2


def test_a_bad_line_is_told_by_its_number(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    lines = [f'{{"k": {i}, "name": "{"x" * (i % 60)}é"}}' if i % 10 else ("  " if i % 20 else "") for i in range(1, 3001)]
    (path / "a.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (path / "b.jsonl").write_text('{"k": 1}\r\n\r\n{"k": 2}', encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = jsonl.numbered_lines(spark, str(path))
        assert got.rdd.getNumPartitions() > 10
        numbered = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in got.collect()}
        assert numbered == {("a.jsonl", i): x for i, x in enumerate(lines, 1)} | {("b.jsonl", i): x for i, x in enumerate(['{"k": 1}', "", '{"k": 2}'], 1)}
        records = jsonl.load_jsonl(spark, str(path), "k int, name string", numbered=True)
        assert records.count() == 2700 + 2 and records.where("file like '%a.jsonl' and k <> line").count() == 0
        lines[1233] = '{"k": 1234, "name": '
        (path / "a.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
        spark.catalog.refreshByPath(str(path))
        with pytest.raises(Exception, match=r"Invalid record at file:.*a\.jsonl:1234"):
            jsonl.load_jsonl(spark, str(path), "k int, name string").agg(F.count(F.lit(1))).collect()
        loose = jsonl.load_jsonl(spark, str(path), "k int, name string", strict=False)
        assert [r[0] for r in loose.where("_corrupt_record is not null").select("_corrupt_record").collect()] == [lines[1233]]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_first_line_of_an_id(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text('{"task_id": "b", "question": "first"}\n{"task_id": "a"}\n{"task_id": "b", "question": "second"}\n')
    tasks = jsonl.load_tasks(spark, str(path), numbered=True)
    assert jsonl.find_task(tasks).first()["question"] == "first" and jsonl.find_task(tasks, "b").first()["question"] == "first" and jsonl.find_task(tasks, "z").count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    jsonl.append(spark.range(3), path)
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception):
        jsonl.append(bad, path)
    assert jsonl.load_jsonl(spark, path, "id long").count() == 3


def test_a_batch_meets_its_own_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    append_new(spark, spark.range(500), path, "id")
    append_new(spark, spark.range(495, 505), path, "id")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(505))
