"""What the methods must decide, at their edges: near-threshold links, pages without names, odd labels, large ids."""

import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.llm import common, embedding_dedup, html_extract, language_id, line_dedup, ngram_join, packing, quality, sampled_pieces, secrets, toxicity
from quern.llm import queries as Q
from tests.llm.test_llm import ODD, brute_components, brute_lines, by_id

BIG = [2**63 - 1, 2**62 + 5, 2**53 + 1, 0, -7, -(2**63)]


# 1 packing


def test_large_ids_stay_exact_beside_null_ones(spark):
    df = spark.createDataFrame([(i, "text") for i in BIG] + [(None, "text")], "doc_id long, text string").coalesce(1)
    assert sorted(r["doc_id"] for r in packing.pack_documents(df).collect() if r["doc_id"] is not None) == sorted(BIG)
    assert sorted(r["doc_id"] for r in quality.score_quality(df).collect() if r["doc_id"] is not None) == sorted(BIG)
    assert {r["doc_id"] for r in ngram_join.jaccard_components(df, 3, 90).collect()} == {*BIG, None}
    assert {r["component_id"] for r in ngram_join.jaccard_components(df, 3, 90).collect()} == {min(BIG), None}


def test_conversations_keep_three_limits(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "some words here " * rng.randint(1, 60)])) for c in [*range(120), None] for t in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"tokens": F.lit("x"), "part": F.lit(1)}).repartition(3)
    limits = packing.Limits(2048, 12, 700)
    out = packing.pack_conversations(df, limits).toPandas()
    ids = packing.coder(packing.vocabulary())
    want = defaultdict(lambda: [0, 0, 0])
    for c, _, role, text in rows:
        n = len(ids(text or ""))
        w = want[-1 if c is None else c]
        w[0], w[1], w[2] = w[0] + n, w[1] + 1, w[2] + (n if role == "assistant" else 0)
    got = {-1 if pd.isna(r.conv_id) else int(r.conv_id): [r.tokens, r.segments, r.loss] for r in out.itertuples()}
    assert got == dict(want)
    sums = out.groupby("sequence_id")[["tokens", "segments", "loss"]].sum()
    alone = out.groupby("sequence_id").size() == 1
    assert ((sums.tokens <= 2048) & (sums.segments <= 12) & (sums.loss <= 700) | alone).all()
    assert len(sums) < 1.3 * max(out.tokens.sum() / 2048, out.segments.sum() / 12, out.loss.sum() / 700) + 3
    assert packing.pack_conversations(df.limit(0)).count() == 0


# 2 lines


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (7, 3)])
def test_batches_and_levels_change_nothing(spark, batches, fanout):
    rng = random.Random(batches)
    lines = [f"line number {i} of all the lines" for i in range(40)]
    rows = [(rng.choice([None, *range(60)]), "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))) for _ in range(150)] + [(9, lines[0])] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = line_dedup.dedup_rows(df, batches=batches, fanout=fanout)
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2], r[3]) for r in out.select("doc_id", "n_lines", "n_dropped", "left_text").collect()) == brute_lines(rows)


# 3 quality


def test_posterior_overrules_a_rule_that_errs():
    """A rule that votes bad on a fifth of the good documents is not believed alone; two that agree with others are."""
    n = len(quality.RULES)
    good, errs = "g" * n, "g" * 9 + "b"
    bad, both = "gb" + "g" * 5 + "b" + "gg", "gb" + "g" * 5 + "b" + "gb"
    post, share, accuracy = quality.estimate({good: 7000, errs: 1800, bad: 500, both: 700})
    assert post[errs] > 0.5 > post[both] and post[bad] < 0.5 and post[good] > 0.9
    assert accuracy[0][9] < accuracy[0][0]  # the rule's accuracy on good documents is found to be lower


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_quality_labels_are_met(spark):
    sf = "/root/testdata/sf0.01"
    out = Q.op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id").toPandas()
    good, bad = out[(out.label == 1) & ~out.base_failed], out[(out.label == 0) & ~out.base_failed]
    assert good.kept.mean() >= 0.98 and bad.kept.mean() <= 0.05 and len(bad) > 20


def test_vocabulary_votes_alike_at_every_length():
    rng = random.Random(1)
    at = quality.RULES.index("closed_words")
    for n in (300, 1900, 2100, 20_000):
        few = " ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(n))
        many = " ".join(str(rng.randrange(n * n)) for _ in range(n))
        assert quality.features_of(few)[-1][at] == "b" and quality.features_of(many)[-1][at] == "g"


def test_runs_are_merged_as_they_lie(spark):
    """No shuffle and no sort of a run in an anti-join, nor in a merge of two."""
    docs = lambda lo: spark.createDataFrame([(i, f"line number {i % 70 + lo} of all the lines") for i in range(lo, lo + 200)], "doc_id long, text string")
    tables = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("quern_run_")}
    before, runs = tables(), line_dedup.LineRuns(spark, fanout=4)
    try:
        for lo in (0, 30, 60):
            line_dedup.first_seen(runs, docs(lo))
        x, y = runs.levels[0][:2]
        for df in (line_dedup._anti(spark.table(x), spark.table(y)), runs._merged([x, y])):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan, plan
        assert runs.rows().count() == 130
    finally:
        runs.forget()
    assert tables() == before


# 4 HTML


def text_of(page, importance=None):
    return html_extract.kept(page, importance or {}, 0.35)


def test_names_alone_do_not_empty_an_article():
    assert text_of('<div class="layout has-sidebar"><article><p>Real text.</p></article></div>') == ["Real text."]
    assert text_of('<div class="no-sidebar"><main><p>M</p></main></div>') == ["M"]
    assert text_of('<article><div class="post-header"><h1>Title</h1></div><p>x</p></article>') == ["Title", "x"]
    assert text_of('<div id="sidebar"><article><p>only</p></article></div>') == ["only"]
    assert text_of('<div id="sidebar"><article>teaser</article></div><article>a</article><div class="user-comments">c</div>') == ["a"]
    assert text_of("<p>x <span hidden>no</span> y<button>b</button> z</p>") == ["x y z"]
    assert text_of("a &lt; b < c &amp;am<b>p;</b>") == ["a < b < c &amp;"]


def test_comments_and_teasers_go_whatever_their_tags():
    main = "<main><article><p>one</p></article>{}</main>"
    for more in (
        '<article class="comment"><p>reader says</p></article>', '<section id="user-discussion"><article><p>reader says</p></article></section>', '<div class="more-stories"><article><p>teaser</p></article></div>',
        '<article id="div-comment-12" class="comment-body"><p>x</p></article>', '<article class="teaser">x</article>', '<div class="ad">x</div>', '<article class="promo"><p>x</p></article>',
    ):
        assert text_of(main.format(more)) == ["one"], more
        assert text_of(f"<article><p>one</p>{more}</article>") == ["one"], more
        assert text_of(f"<article><p>one</p></article>{more}") == ["one"], more
    assert text_of("<main><article><p>one</p></article><article><p>two</p></article></main>") == ["one", "two"]


def test_subjects_of_an_article_need_the_tree_to_go(spark):
    legal = '<article><div class="legal"><p>The legal article text</p></div></article>'
    search = '<article><section id="search-form"><p>About search form design</p></section></article>'
    assert text_of(legal) == ["The legal article text"] and text_of(search) == ["About search form design"]
    assert text_of('<article class="legal"><p>t</p></article>') == ["t"] and text_of('<div class="legal">all rights</div><article>a</article>') == ["a"]
    rows = [(i, "http://a.example/", f'<article><p>Text number w{i}</p><div class="legal"><p>All rights reserved by the site</p></div></article>') for i in range(200)]
    rows += [(500 + i, f"http://b{i}.example/", f'<article><div class="legal"><p>Case w{i} of the court</p></div></article>') for i in range(30)]
    out = {r["page_id"]: r["text"] for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: f"Text number w{i}" for i in range(200)} | {500 + i: f"Case w{i} of the court" for i in range(30)}


@pytest.mark.parametrize("depth", [1, 7, 40])
def test_branches_reach_to_the_root(spark, depth):
    """What hangs below each node, at any depth, against adding up."""
    rng = random.Random(depth)
    rows, up, value = [], {0: None}, {}
    for n in range(1, 120):
        up[n] = n - 1 if n <= depth else rng.randrange(n)
    for host in ("a", "b"):
        for n in up:
            value[host, n] = (rng.randint(1, 9), rng.choice([None, rng.random()]))
            rows.append((host, n, *value[host, n], up[n]))
    got = {(r["host"], r["node"]): r["below"] for r in html_extract._below(spark.createDataFrame(rows, "host string, node long, m long, content double, up long").repartition(3)).collect()}
    want = {}
    for (host, n), (m, c) in value.items():
        p = up[n]
        while c is not None and p is not None:
            w, s = want.get((host, p), (0.0, 0))
            want[host, p] = w + m * c, s + m
            p = up[p]
    assert got == pytest.approx({k: w / s for k, (w, s) in want.items()})


def test_long_names_are_told_apart():
    one, two = (html_extract.blocks(f"<div class='{'x' * 80}{c}'>t</div>")[0][1] for c in "ab")
    assert one != two


def test_a_deep_page_is_cheap():
    parents, layouts = {}, []
    found = html_extract.blocks("<div>" * 20_000 + "text", layouts, parents)
    assert [text for *_, text in found] == ["text"] and len(parents) == 20_000


@pytest.mark.parametrize("piece", ["<a ", "<i><p>x", '<a "', '<a ">" "', "<div>", "<!-- ", "</p><li>", "<p>x</b>", "<", "&amp"])
def test_broken_pages_take_time_in_proportion(piece):
    import time

    took = []
    for n in (10_000, 40_000):
        began = time.perf_counter()
        html_extract.blocks(piece * n, [])
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.3


def test_the_tree_decides_where_names_say_nothing(spark):
    """Articles, menus, notices and footers in elements whose names tell nothing; some notices are of a few kinds."""
    rng = random.Random(5)
    sentence = lambda: " ".join(key for key in (rng.choice("aeiou") + str(rng.randrange(10**6)) for _ in range(12)))
    menu, foot = "".join(f"<li>Entry {i}</li>" for i in range(6)), "All rights of the site"
    notices = [f"Notice of kind {i} for all readers" for i in range(3)]
    rows, want = [], {}
    for i in range(300):
        host = f"h{i % 3}.example"
        body = [sentence() for _ in range(rng.randint(1, 5))]
        want[i] = "\n".join(body)
        page = f"<body><div class=q1><ul>{menu}</ul></div><div class=q2>{rng.choice(notices)}</div><div class=q3>{''.join(f'<p>{b}</p>' for b in body)}</div><div class=q4><p>{foot}</p></div></body>"
        rows.append((i, f"http://{host}/{i}", page))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    out = {r["page_id"]: r["text"] for r in html_extract.extract_text(df).collect()}
    assert out == want
    for _, _, page in rows[:1]:  # every block was the tree's to decide
        assert {kind for kind, *_ in html_extract.blocks(page)} == {html_extract.OPEN}


def test_equal_pages_and_hot_hosts(spark):
    page = "<body><div class=a1><p>Same text everywhere</p></div><div class=a2><p>Own text {i}</p></div></body>"
    rows = [(i, "http://one.example/", page.format(i=i % 40)) for i in range(200)] + [(1000 + i, None, "<p>x</p>") for i in range(3)] + [(None, "", None)]
    out = html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows) and all(r["text"] == f"Own text {r['page_id'] % 40}" for r in out if r["page_id"] is not None and r["page_id"] < 1000)


# 6 n-gram join

FOUR = [
    (1, "jmhtqx duotvw jpjlwg qzklzm bkswyr yrcbuh njurmr etrebg urrqnl vrhinu duotvw jpjlwg axddcy"),
    (2, "aexozb pzorjj qzklzm ubkicm iddsec etrebg urrqnl yrcbuh iddsec etrebg urrqnl vrhinu jmhtqx bkswyr yrcbuh iddsec"),
    (3, "xfkltr aexozb pzorjj qzklzm bkswyr yrcbuh iddsec etrebg urrqnl vrhinu jmhtqx duotvw jpjlwg axddcy"),
    (4, "xfkltr aexozb pzorjj qzklzm bkswyr yrcbuh iddsec etrebg urrqnl vrhinu jmhtqx duotvw jpjlwg axddcy nqmavz"),
]


@pytest.mark.parametrize("parts", [1, 4])
def test_a_link_behind_weaker_neighbours(spark, parts):
    out = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(FOUR, "doc_id long, text string").repartition(parts), 3, 90).collect()}
    assert out == {1: 1, 2: 2, 3: 3, 4: 3}


def near_threshold(seed, n, percent):
    """Clusters of texts that differ about as much as the threshold allows, over few words, with half-copies between."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    out = []
    while len(out) < n:
        base = [rng.choice(words) for _ in range(rng.choice([4, 8, 13, 20, 40, 80, 150]))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, int(len(w) * (100 - percent) / 250) + 1))):
                i = rng.randrange(len(w))
                kind = rng.random()
                if kind < 0.4:
                    w[i] = rng.choice(words)
                elif kind < 0.7:
                    w.insert(i, rng.choice(words))
                elif len(w) > 3:
                    del w[i]
            if rng.random() < 0.3:
                w = w[: len(w) // 2] + [rng.choice(words) for _ in range(len(w) // 2)]
            out.append(" ".join(w))
    return list(zip([*rng.sample(range(2**62), len(out) - len(BIG)), *BIG], out))


@pytest.mark.parametrize("words,percent,block", [(3, 90, 200), (5, 80, 10), (3, 80, 10)])
def test_random_clusters_near_the_threshold(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_threshold(words * percent, 1200, percent)
    want, _ = brute_components(rows, words, percent)
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), words, percent)
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == want and len(set(want.values())) < len(want) - 50


def test_a_large_group_of_several_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    rng = random.Random(3)
    rows = []
    for i in range(400):
        w = [f"w{k}" for k in range(100)]
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    want, _ = brute_components(rows, 3, 90)
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 90)
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == want and 10 < len(set(want.values())) < 390


def chain(n, step=24):
    """Windows of one text: neighbours share many fragments and are a little too different to link, others share few or none."""
    text = [f"w{zlib.crc32(str(i).encode())}" for i in range(200 + step * n)]
    return [(i, " ".join(text[i * step : i * step + 200])) for i in range(n)]


def test_a_chain_costs_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    verified, rows = ngram_join._verified, []

    def counted(blocks, percent):
        rows.append(blocks.count())
        return verified(blocks, percent)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    took = []
    for n in (300, 600):
        rows.clear()
        docs = chain(n) + [(10_000 + i, t) for i, t in chain(n)[::50]] + [(20_000, chain(n)[7][1] + " more")]
        out = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 5, 80).collect()}
        assert out == {i: 7 if i == 20_000 else i - 10_000 if i >= 10_000 else i for i, _ in docs}
        assert len(rows) == 2  # one group, compared within blocks and then by fragment
        took.append(rows[1])
    assert n < took[1] < 2.6 * took[0] and took[1] < n * (n / 10) / 2  # all with all would be a row of each document in each block


def test_a_common_passage_hangs_nothing_together(spark):
    """F1 of round 4: a passage of all and one of a neighbour are enough together; documents hang by the rarer one."""
    words = lambda *key: " ".join(f"w{zlib.crc32(str((*key, i)).encode())}" for i in range(150))
    rows = [(i, " ".join([words("all"), words("two", i // 2), words("own", i), words("rest", i)])) for i in range(80)]
    rows += [(i, rows[i - 100][1] + " more") for i in range(100, 180, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = ngram_join._candidates(df, 5, 80)[0]
    assert found.groupBy("component").count().agg(F.max("count")).first()[0] <= 4
    linked = {r["node"]: r["component"] for r in ngram_join.link_components(df, 5, 80).collect()}
    assert linked == {i: i if i < 100 else i - 100 for j in range(100, 180, 10) for i in (j, j - 100)}


def test_what_two_have_in_common_they_hang_by():
    rng = random.Random(5)
    sets = [set(rng.sample(range(60), 30)) | {100 + i % 7} for i in range(40)]
    need = [rng.randint(5, 20) for _ in sets]
    often = {x: sum(x in s for s in sets) for s in sets for x in s}
    rows = [(i, 0, ngram_join.BUCKET, x, often[x]) for i, s in enumerate(sets) for x in s] + [(i, 0, ngram_join.NEED, 0, k) for i, k in enumerate(need)]
    frame = pd.DataFrame(sorted(rows), columns=["node", "class", "kind", "other", "n"])
    by = {i: set() for i in range(len(sets))}
    for key, who in ngram_join._hanging([frame[:333], frame[333:350], frame[350:]]):
        for x, i in zip(key.tolist(), who.tolist()):
            by[i].add(x)
    assert all(len(by[i]) == max(0, len(s) - need[i] + 1) for i, s in enumerate(sets))
    met = [(i, j) for i in range(40) for j in range(i) if len(sets[i] & sets[j]) >= max(need[i], need[j])]
    assert len(met) > 100 and all(by[i] & by[j] for i, j in met)


def test_shuffles_go_once_a_table_is_written(spark):
    """F1 of round 4: shuffle files stayed until the driver collected garbage."""
    kept = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    spark._jvm.System.gc()
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", kept()
    was = spark.conf.get(key, None)
    out = common.written(spark.range(1000).groupBy(F.col("id") % 7).count(), "counts")
    assert kept() <= before and out.count() == 7 and spark.conf.get(key, None) == was
    common.discard(out)


# 7 language


def test_each_letter_has_its_own_vector():
    space = language_id.Space()
    cp = np.array([ord(c) for c in "aézжш漢字𠀀ア"], np.int64)
    v = space.letters(cp).astype(float)
    cos = v @ v.T / language_id.DIMENSIONS
    assert (np.abs(cos - np.eye(len(cp))) < 0.15).all()
    small = language_id.Space(keep=4)  # vectors are made again when there is no room
    for t in ("Слово и дело", "漢字かな", "plain words", "é"):
        assert np.allclose(small.bundle(t), space.bundle(t))


def test_languages_of_other_scripts(spark):
    rng = random.Random(8)
    syllables = {"ru": ["сло", "во", "ни", "жа", "ши"], "uk": ["сло", "ві", "ни", "жа", "ґу"], "zh": ["漢", "字", "文", "語"], "ja": ["カ", "ナ", "漢", "ノ"], "xx": ["\U00030000", "\U00030001"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(4)) for _ in range(15)), lang) for i in range(400) for lang in [rng.choice(list(syllables))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit("clash"), "score": F.lit("clash"), "_p": F.lit(1)})
    out = language_id.predict_language(df, language_id.learn(df.where("doc_id % 4 <> 2")))
    held = [r for r in out.collect() if r["doc_id"] % 4 == 2]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held) and "_p" in out.columns
    assert language_id.predict_language(df.limit(0), language_id.learn(df)).count() == 0


# 8 embeddings


@pytest.mark.parametrize("dim", [8, 64, 768])
def test_pairs_at_the_threshold_share_a_cell(dim):
    rng = np.random.default_rng(dim)
    for cosine in (0.9801, 0.99):
        a = rng.standard_normal((2000, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.standard_normal((2000, dim))
        b -= (b * a).sum(axis=1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        b = cosine * a + np.sqrt(1 - cosine**2) * b
        x, y = (embedding_dedup.cells(v, 0.98) for v in (a, b))
        assert (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean() >= 0.999


@pytest.mark.parametrize("block", [7, 500])
def test_links_are_counted_once_over_cells_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(block)
    centre = rng.normal(size=(3, 16))
    x = np.repeat(centre, 40, axis=0) + rng.normal(size=(120, 16)) * np.repeat(rng.choice([0.01, 0.08, 0.12], 120)[:, None], 16, axis=1)
    rows = [(i, v.tolist(), str(i % 2)) for i, v in enumerate(x)]
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(4)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.98) & (np.arange(120)[:, None] % 2 == np.arange(120) % 2)
    np.fill_diagonal(hit, False)
    assert [out[i]["n_links"] for i in range(120)] == hit.sum(axis=1).tolist() and hit.sum() > 200


# 9 pieces


def test_noncharacters_and_marks_come_back():
    lat = sampled_pieces.lattice(sampled_pieces.vocabulary(), 1.0)
    for x in [*[x for x in ODD if x], "a﷐b", "﷐" * 60, "▁" * 100, "﷐▁ ﷑", "😀 x\U0010ffff", "日本語" * 50, "\x00 \x07"]:
        assert lat.decode(lat.sample(x, 3)) == x


def test_pieces_are_the_same_in_any_batch():
    lat = sampled_pieces.lattice(sampled_pieces.vocabulary(), 1.0)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdeinorst.é") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 60))) for _ in range(60)] + [x for x in ODD if x]
    seeds = [rng.randrange(2**64) for _ in texts]
    together = lat.sample_batch(texts, seeds)
    order = rng.sample(range(len(texts)), len(texts))
    turned = lat.sample_batch([texts[i] for i in order], [seeds[i] for i in order])
    for i, t in enumerate(texts):
        alone = lat.sample_batch([t], [seeds[i]])[0]
        assert (together[i] == alone).all() and (turned[order.index(i)] == alone).all()


def test_existing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "some text"), (None, None)], "doc_id long, text string").withColumns({"pieces": F.lit("x"), "scan": F.lit("y"), "score": F.lit("z")})
    assert {r["doc_id"]: r["pieces"] is None for r in sampled_pieces.encode_sampled(df, "doc_id").collect()} == {1: False, None: True}
    assert {r["doc_id"]: r["scan"]["redacted"] for r in secrets.scan_secrets(df).collect()} == {1: "some text", None: ""}
    empty = df.limit(0)
    assert sampled_pieces.encode_sampled(empty, "doc_id").count() == 0
    model = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {type(r["score"]) for r in toxicity.score_toxicity(df, model).collect()} == {float} and toxicity.score_toxicity(empty, model).count() == 0


# 10 toxicity


def test_odd_labels_are_left_out(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} glorp" if i % 3 == 0 else f"word{i % 7} fine") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 3 == 0 else 0) for i in range(200)] + [(i, x) for i in range(200) for x in (2, -1, None)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = by_id(toxicity.score_toxicity(docs, model), "score")
    assert all((out[i][0] >= 0.5) == (i % 3 == 0) for i in range(200))


def test_long_runs_take_time_in_proportion():
    import time

    for piece in ("x", "a1", "1", "A!", "*a"):
        began = time.perf_counter()
        toxicity.features(piece * 200_000, {"glorp": 1.0})
        assert time.perf_counter() - began < 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_held_out_labels_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    out = Q.op10_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert ((out.predicted == 1) == (out.toxic == 1)).mean() >= 0.95 and out.predicted[out.toxic == 0].mean() <= 0.02
    out = Q.op7_language(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.lang_pred == out.lang)[out.lang.notna()].mean() >= 0.98


# the registered queries and the pipeline

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_queries_match_their_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in Q.oracle_sql().items():
        got, ran = Q.queries()[name](spark, sf), con.execute(sql)
        columns = [c[0] for c in ran.description]
        assert sorted(got.columns) == sorted(columns), name
        want = sorted(ran.fetchall(), key=repr)
        assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == want, name


CONTRACT = {
    "op1_pack": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op2_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op3_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op4_html_extract": "page_id url text n_chars",
    "op5_secrets": "doc_id n_assign n_access n_hex base_sha256 spans", "op6_ngram_join": "doc_id n_shingles component_id", "op7_language": "doc_id held_out lang_pred score",
    "op8_embedding_dedup": "vec_id n_links component_id kept", "op10_toxicity": "doc_id held_out score predicted",
    "op11_lloyd": "vec_id cluster distance cluster_inertia inertia centroid_sha256", "op12_warc": "page_id payload_bytes payload_digest record_type refers_to", "op13_ranked_search": "item_id rank doc_id score",
}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_queries_have_the_columns_asked_for(spark):
    sf = "/root/testdata/sf0.001"
    for name, columns in CONTRACT.items():
        out = Q.queries()[name](spark, sf)
        assert out.columns[: len(columns.split())] == columns.split(), name
        assert name in ("op1_pack", "op13_ranked_search") or out.count() == spark.read.parquet(f"{sf}/{'embeddings' if name in ('op8_embedding_dedup', 'op11_lloyd') else 'pages' if name in ('op4_html_extract', 'op12_warc') else 'documents'}.parquet").count()
    digests = Q.op9_sampled_pieces(spark, sf).collect()
    assert all(r["lossless"] for r in digests)
    fold = {r["doc_id"]: r["held_out"] for r in Q.op10_toxicity(spark, sf).collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 5 == 0) for k, v in fold.items())


def test_each_stage_against_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeghiklmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    shared = ["this very line stands in many documents", "so does this other line of text"]
    rows, toxic = [], []
    for i in range(500):
        t = [rng.choice(words) for _ in range(rng.randint(30, 80))]
        bad = i % 6 == 0
        for _ in range(4 if bad else 0):
            t[rng.randrange(len(t))] = rng.choice(["glorp", "zwick"])
        text = " ".join(t)
        if i % 4 == 1:
            text = text + "\n" + rng.choice(shared)
        if i % 9 == 2:
            text += " password = hunter2hunter2 end"
        rows.append((i, text)), toxic.append(bad)
    rows += [(1000 + i, rows[i][1] + " extra") for i in range(1, 60)] + [(2000, None), (2001, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(P.STAGES)
    kept = {name: [] for name in stage}
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, run in P.STAGES[:-1]:
        run(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted((r["doc_id"], r["text"]) for r in at.select("doc_id", "text").collect() if r["text"]) if name else []
    ids = {i for i, _ in kept["toxicity"]}
    assert not any(b and i in ids for i, b in enumerate(toxic)) and all(i in ids for i, b in enumerate(toxic) if not b)
    want = {(d, t) for d, _, n, t in brute_lines(kept["toxicity"]) if n == 0 or t.strip(" ")}
    assert set(kept["line_dedup"]) == want and want != set(kept["toxicity"])
    classes, _ = brute_components(kept["line_dedup"], 5, 80)
    assert kept["near_duplicates"] == [(i, t) for i, t in kept["line_dedup"] if classes[i] == i] and len(kept["near_duplicates"]) < len(kept["line_dedup"])
    left = dict(kept["secrets"])
    assert left.keys() == dict(kept["near_duplicates"]).keys()
    for i, t in kept["near_duplicates"]:
        assert left[i] == secrets.redact(t, secrets.base_spans(t), "[secret]"), i
    out = stage["packing"](spark, at, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    ids_of = packing.coder(packing.vocabulary())
    assert {r["doc_id"]: r["n"] for r in out} == {r["doc_id"]: len(ids_of(r["text"] or "")) for r in at.select("doc_id", "text").collect()}
