"""Token counts against the vocabulary's own library."""

import pytest
from pyspark.sql import functions as F

from quern.functions.counting import fits, token_counts
from quern.sources import jsonl

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")


def test_counts_are_the_vocabularys(spark):
    path = vocabularies.path("byte_bpe_50k.json")
    texts = ["", "SELECT n_name FROM nation", "été 數據 🙂", "<|endoftext|>", "a" * 5000, None, "\x00\n\t "]
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    got = {r["i"]: (r["n"]["tokens"], r["n"]["chars"]) for r in df.select("i", token_counts(F.col("text"), path).alias("n")).collect()}
    assert got == {i: (n, len((x or "").encode())) for i, (n, x) in enumerate(zip(want, texts))}
    assert df.limit(1).select(fits(F.array(F.lit(3), F.lit(4)), 7), fits(F.array(F.lit(3), F.lit(5)), 7)).first()[:] == (True, False)


def test_counts_by_ranks_are_the_same(spark):
    """F8: the file of ranks counts as the vocabulary does, texts that its pattern can't take included."""
    path = vocabularies.path("byte_bpe_50k.json")
    texts = ["", "SELECT n_name  FROM\n\n nation's", "été 數據 🙂\u3000x", "<|endoftext|>", "a" * 5000, None, "\x00\n\t ", " " * 1_000_000 + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    n = [token_counts(F.col("text"), path, *x).alias(a) for a, x in (("plain", ()), ("ranked", (vocabularies.path("byte_bpe_50k.tiktoken"),)))]
    rows = df.select("i", *n).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["plain"] == r["ranked"] and r["ranked"]["chars"] == len((texts[r["i"]] or "").encode())


def test_a_collection_is_finished_once_and_whole(spark, tmp_path):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "id int, s string")
    for totals in ({"a": 5}, {"a": 5, "b": 4}, {"a": 5, "b": 5, "c": 1}):
        with pytest.raises(ValueError):
            jsonl.finalize(rows, totals, "s", str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    assert dict(jsonl.finalize(rows, {"a": 5, "b": 5, "c": 0}, "s", str(tmp_path / "out")).collect()) == {"a": 5, "b": 5}
    assert jsonl.read_manifest(spark, str(tmp_path / "out" / "manifest.json")) == {"a": 5, "b": 5}
    with pytest.raises(Exception):
        jsonl.finalize(rows, {"a": 5, "b": 5}, "s", str(tmp_path / "out"))


def test_places_of_tokens_split_a_text_once(spark, tmp_path):
    """k18 splits off forty words and folds over them once for starts and once for ends, however long the text."""
    from quern import queries

    texts = ["the e " * 50_000, "x" * 40 + " e", "no", "", None, "  e  "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.queries()["k18_tokens_inside"](spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2

    def inside(text):
        first, at, n = text.find("e") + 1, 0, 0
        for w in text.split(" ")[:40]:
            n += at < first + 29 and at + len(w) > first - 1
            at += len(w) + 1
        return n

    got = dict(map(tuple, out.collect()))
    assert all(got[i] == inside(x) for i, x in enumerate(texts) if x is not None) and len(got) == len(texts)


def test_tokens_beyond_the_fortieth_are_inside_too(spark, tmp_path):
    """F2 of round 4: k18 left out what followed the fortieth token, and so did its SQL."""
    import duckdb

    from quern import queries
    from quern.operators import scoring

    texts = ["a " * 60 + "e b c", "a " * 45 + "x" * 20 + "e b c dd " + "f " * 50, " " * 70, "e" + " " * 99, "e a", "", None, "a " * 20_000 + "é e"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.queries()["k18_tokens_inside"](spark, str(tmp_path))
    got = dict(map(tuple, out.collect()))

    def places(text):
        at = 0
        for w in text.split(" "):
            yield at, at + len(w)
            at += len(w) + 1

    def inside(text):
        first = text.find("e") + 1
        return sum(a < first + 29 and b > first - 1 for a, b in places(text))

    assert got == {i: None if x is None else inside(x) for i, x in enumerate(texts)} and got[0] == 3 and got[2] == 29
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet') WHERE doc_id < 7")
    assert dict(c.sql(queries.oracle_sql()["k18_tokens_inside"]).fetchall()) == {i: n for i, n in got.items() if i < 7}
    a, b = zip(*places(texts[1]))
    mask = scoring.sql_token_mask(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)), F.lit(texts[1].find("e")), F.lit(texts[1].find("e") + 30))
    assert sum(spark.range(1).select(mask).first()[0]) == got[1]
