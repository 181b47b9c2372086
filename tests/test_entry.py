"""The entry points: the command line, and what the driver imports."""

import json
import os

import pytest

import __spark_entry__
from quern.__main__ import main

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def read(path):
    return [json.loads(x) for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


def test_list_and_run(spark, tmp_path, capsys):
    assert main(["list"], spark) == 0
    assert "r1_filter" in capsys.readouterr().out.split()
    main(["run", "r7_distinct", SF, "--out", str(tmp_path / "out")], spark)
    assert len(read(tmp_path / "out")) == __spark_entry__.queries()["r7_distinct"](spark, SF).count()
    with pytest.raises(Exception):
        main(["run", "r7_distinct", SF, "--out", str(tmp_path / "out")], spark)
    with pytest.raises(SystemExit):
        main(["run"], spark)


def test_score_and_verify(spark, tmp_path):
    rows = [
        {"task_id": "a", "pred_sql": "SELECT n_name FROM nation", "gold_sql": "SELECT n_regionkey FROM nation"}, {"task_id": "b", "pred_sql": "SELECT n_name FROM nation", "gold_sql": "SELECT n_name FROM nation n"}, {"task_id": "c", "pred_sql": "SELEC", "gold_sql": "SELECT 1"},
    ]
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    main(["score", str(path), SF, "--out", str(tmp_path / "scores")], spark)
    got = {r["line"]: r for r in read(tmp_path / "scores")}
    assert [got[i]["status"] for i in (1, 2, 3, 4)] == ["scored", "scored", "unscorable:parse_error", "unscorable:invalid_json"]
    assert (got[1]["task_id"], got[1]["distance"], got[2]["similarity"]) == ("a", 1, 1.0)
    main(["verify", str(path), SF, "--out", str(tmp_path / "verdicts"), "--left", "pred_sql", "--right", "gold_sql"], spark)
    told = {r["line"]: r for r in read(tmp_path / "verdicts")}
    assert [told[i]["correct"] for i in (1, 2, 3, 4)] == [False, True, False, False] and told[3]["error"] == "parse_error"


def test_what_the_driver_asks_for(spark):
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and all(map(callable, names.values()))
    assert __spark_entry__.entry(spark).columns
