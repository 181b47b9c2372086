"""The corpus operators against brute force, round trips and held-out labels, with odd inputs in each table."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import boosting, components, embedding_dedup, html_extract, language_id, line_dedup, ngram_join, packing, quality, sampled_pieces, secrets, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \t\n", "\n\n\n", "é" * 50, "one", "Ⅷ ² ½\x1c\x85 x", "日本語 テキスト " * 20, "a" * 30_000, "▁ literal ▁▁ mark\r\n"]


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 14))).capitalize() + "." for _ in range(60)]
    texts = []
    for i in range(n):
        body = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 30))) for _ in range(rng.randint(1, 6))]
        body += rng.sample(lines, 2) + [lines[0], "  " + lines[1].upper() + "\t"]
        rng.shuffle(body)
        texts.append("\n".join(body))
    for i in range(20):  # near copies
        w = texts[i % 4].split(" ")
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    return texts + ODD + [texts[5], texts[5], None]


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "no id at all", None, None, None), (7, texts[7], "en", "s", 0)]
    df = spark.createDataFrame(rows, DOC).withColumns({"n_lines": F.lit(1), "part": F.lit("x"), "key": F.lit(2), "score": F.lit("clash")})
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# 1 packing


def test_packed_ids_are_those_of_tokenizers_by_default(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    more = ["a <|endoftext|> b", "a<|endoftext|>b", "  <|endoftext|>  \n x", "<|endoftext|><|endoftext|>", "<|endoftext|", "don't <|ENDOFTEXT|> stop\n<|endoftext|>\n"]
    every = [*more, *(x for x in texts if x)]
    want = [[*t.encode(x, add_special_tokens=False).ids, 1] for x in every]
    ids = packing.coder(packing.vocabulary())
    assert [ids(x).tolist() for x in every] == want
    for r in packing.pack_documents(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")).collect():
        w = np.array(want[r["doc_id"]], "<u4")
        assert r["doc_tokens"] == len(w) and r["ids_crc32"] == zlib.crc32(w[r["start"] : r["start"] + r["length"]].tobytes())


def test_packing_places_each_id_once(spark, docs, texts, empty):
    limits = packing.Limits(tokens=128, loss=128, segments=5)
    out = packing.pack_documents(docs, limits, window=8).toPandas()
    ids = packing.token_ids(packing.vocabulary())
    want = defaultdict(int)
    for r in docs.select("doc_id", "text").collect():
        want[r["doc_id"]] += len(ids(r["text"] or ""))
    got = out.fillna({"doc_id": -1}).groupby("doc_id")["length"].sum().to_dict()
    assert got == {(-1 if k is None else k): v for k, v in want.items()}
    for r in out[out.doc_id.isin(range(len(texts))) & (out.doc_id != 7)].astype("int64").itertuples():
        whole = ids(texts[r.doc_id] or "")
        assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())
    padding = 0
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.r_[0, s.length.cumsum().to_numpy()[:-1]]).all() and len(s) <= 5
        n = int(s.length.sum())
        assert n <= 128
        padding += 0 if n & (n - 1) == 0 else 128 - n
    assert padding <= 0.02 * out.length.sum()
    assert packing.pack_documents(empty).count() == 0


def test_instruction_packing_keeps_all_limits(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 900), rng.randint(1, 5), None if i == 3 else rng.randint(0, 400), "x") for i in range(300)] + [(999, 5000, 1, 10, "x")]
    df = spark.createDataFrame(rows, "id int, t int, s int, l int, part string").repartition(2)
    out = packing.pack_examples(df, "id", "t", "s", "l", packing.Limits(2048, 8, 600)).toPandas()
    assert sorted(out.id) == sorted(r[0] for r in rows)
    sums = out.groupby("sequence_id")[["tokens", "segments", "loss"]].sum()
    big = set(out[out.id == 999].sequence_id)
    fits = sums[~sums.index.isin(big)]
    assert (fits.tokens <= 2048).all() and (fits.segments <= 8).all() and (fits.loss <= 600).all()
    assert len(sums) < 1.25 * max(out.tokens.sum() / 2048, out.segments.sum() / 8, out.loss.sum() / 600) + 2


# 2 line dedup


def brute_lines(rows, min_docs=3):
    held = defaultdict(list)
    keyed = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keys = [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r")) for x in lines]
        keyed.append((d, lines, keys))
        for k in {k for k in keys if len(k) >= 20}:
            held[k].append(d)
    rank = lambda d: -1 if d is None else d
    out = []
    for d, lines, keys in keyed:
        keep = [x for x, k in zip(lines, keys) if not (k in held and len(held[k]) >= min_docs and rank(d) != max(map(rank, held[k])))]
        out.append((rank(d), len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


def test_line_dedup_matches_brute_force(docs, empty):
    got = sorted((-1 if r[0] is None else r[0], r[1], r[2], r[3]) for r in line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text").collect())
    assert got == brute_lines([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])
    assert line_dedup.dedup_lines(empty).count() == 0


def test_runs_are_levelled_and_first_seen_wins(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    kept = []
    for batch in ([(1, "a" * 20), (2, "b" * 20)], [(3, "a" * 20), (4, "c" * 20)], [(5, "c" * 20), (6, "d" * 20), (7, "d" * 20)]):
        kept += [r["doc_id"] for r in line_dedup.first_seen(runs, spark.createDataFrame(batch, "doc_id long, text string")).collect()]
    assert sorted(kept) == [1, 2, 4, 7]
    # New keys of three batches, and raises of two, merged by pairs.
    assert [len(x) for x in runs.levels] == [1, 1] and [len(x) for x in runs.raises] == [0, 1]
    assert sorted((r["n"], r["hi"]) for r in runs.rows().collect()) == [(1, 2), (2, 3), (2, 5), (2, 7)]


# 3 quality


def test_quality_counts(docs, texts, empty):
    got = by_id(quality.score_quality(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = defaultdict(list)
        for j in range(len(words) - 2):
            windows[tuple(words[j : j + 3])].append(j)
        hit = {j + k for at in windows.values() if len(at) > 1 for j in at for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed)
        assert got[i][:6] == want, i
        assert not (failed and got[i][6])
    assert quality.score_quality(empty).count() == 0


def test_votes_separate_good_from_bad():
    post, share, accuracy = quality.estimate({"g" * 10: 900, "gbggggbggg": 60, "ggg-gggggg": 40, "gggbbggggb": 20})
    assert post["g" * 10] > 0.9 and post["gbggggbggg"] < 0.1 and post["gggbbggggb"] < 0.1 and 0.8 < share < 1
    assert quality.estimate({})[0] == {}


# 4 HTML


PAGE = (
    '<!DOCTYPE html><html><head><title>T{i}</title><style>p{{a:b}}</style><script>var x="</p>";</script></head><body><nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies</div>'
    '<div id="wrap{i}"><div class="content"><article><h1>Title {i}</h1><p>First &amp; {i}\n  words <b>bold<br><p>Second&nbsp;{i} paragraph</p><aside>Ad {i}</aside></article></div><div class="box">Same on all pages</div></div>'
    "<section class=\"comments\"><p>I like {i}</p></section><form><input>Search</form><footer>&copy; site</footer>"
)


def test_extraction_keeps_the_article(spark):
    rows = [(i, "https://a.example/x", PAGE.format(i=i)) for i in range(30)] + [(90, None, None), (91, "bad url", ""), (92, "https://b.example/", "<p>only text"), (93, "https://c.example", "no markup < at all & more")]
    out = {r["page_id"]: r["text"] for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    for i in range(30):
        assert out[i] == f"Title {i}\nFirst & {i} words bold\nSecond {i} paragraph"
    assert out[90] == out[91] == "" and out[92] == "only text" and out[93] == "no markup < at all & more"
    assert html_extract.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_branches_without_names_go(spark):
    page = "<body><div class='xa'><p>Article number {i} with words {i}</p></div><div class='xb'><p>The same line on each page</p></div></body>"
    df = spark.createDataFrame([(i, "http://h.example/", page.format(i=i)) for i in range(40)], "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.extract_text(df).where("page_id = 3").collect()} == {"Article number 3 with words 3"}


# 5 secrets


def test_few_decoys_find_nothing():
    assert secrets.thresholds([(0, 1, secrets.CELLS - 1, 2, 0), (0, 1, 0, 0, 20)], 0.01)[0, 1] == secrets.CELLS
    limits = secrets.thresholds([(5, 2, secrets.CELLS - 5, 1, 0), (5, 2, 0, 0, 500)], 0.01)
    assert limits[5, 2] < secrets.CELLS - 4 and limits[5, 1] == limits[4, 2] == secrets.CELLS


def brute_spans(t):
    out = []
    low = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(low, t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_spans(spark, docs, texts, empty):
    rng = random.Random(5)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(64))
    more = [f'é PassWord = "{"x" * 5}" token:abcdef secret = {"0a" * 20}', "AKIA" + "Z9" * 8 + " AKIA123", "api_key='k.k-k_k/k+k=' APIKEY: 123456", f"text {texts[0]} {key} after", "ſecret = 123456789 toKen=1234567"]
    every = [*texts, *more]
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    out = by_id(secrets.scan_secrets(df), "scan")
    for i, t in enumerate(every):
        want = brute_spans(t or "")
        got = out[i][0]
        assert [got["n_assign"], got["n_access"], got["n_hex"]] == [sum(k == j for _, k, _ in want) for j in range(3)]
        assert got["base_sha256"] == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert set(secrets.joined(want).split(",")) <= set(got["spans"].split(",")) | {""}
    assert "0a0a" not in out[len(texts)][0]["redacted"] and out[0][0]["redacted"] == texts[0]
    assert secrets.scan_secrets(empty).count() == 0


def key_of(alphabet, n, rng):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_random_keys_pass_the_battery_and_words_do_not():
    rng = random.Random(9)
    for alphabet, group in secrets.ALPHABETS[1:]:
        p, g = secrets.scores([key_of(alphabet, 40, rng) for _ in range(200)])
        assert np.median(p) > 0.1 and (g == group).mean() > 0.9
    words = [key_of(["the", "ing", "ent", "tion", "er", "he", "an"], 14, rng)[:40] for _ in range(200)]
    p, g = secrets.scores(words)
    assert p.max() < 1e-3 and (g == 1).all()
    p, g = secrets.scores(["short", "", "=" * 30, "with=equals=inside=it=all", "A" * 25 + "=="])
    assert (p < 0.01).all() and g.tolist() == [-1, -1, -1, -1, 0]


def test_decoys_come_from_whole_texts_and_equal_ones_count_once(spark):
    rng = random.Random(7)
    header = " ".join(key_of("abcdefghijklmnopqrst", 6, rng) for _ in range(60))
    texts = [header + " " + " ".join(key_of("abcdefghijklmnopqrst", 6, rng) for _ in range(100)) for _ in range(40)]
    want = []
    for size in secrets.LENGTHS:
        every = set()
        for t in texts:
            w = t.replace(" ", "")
            every |= {w[i : i + size] for i in [*range(0, len(w) - size + 1, size), len(w) - size]}
        want.append(len(every))
    rows = secrets.histograms(spark.createDataFrame([(t,) for t in texts * 3], "text string").repartition(3))
    got = [sum(r[4] for r in rows if r[0] == c) for c in range(len(secrets.LENGTHS))]
    assert all(abs(g - w) <= 0.1 * w + 2 for g, w in zip(got, want)), (got, want)


def test_planted_keys_are_found_and_other_text_is_left(spark):
    """Of keys of each encoding and length nine in ten are found, at a false-discovery rate of 1 %."""
    rng = random.Random(3)
    words = ["".join(rng.choice(["ba", "re", "tion", "ing", "s", "un", "the", "mor", "li", "con", "er", "at"]) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    alphabets = [secrets.ALPHABETS[i][0] for i in (2, 3, 4, 5, 6, 8, 9)]
    rows, planted = [], {}
    for i in range(2000):
        t = [rng.choice(words) for _ in range(150)]
        if i % 2:
            k = key_of(alphabets[i // 2 % 7], (20, 24, 32, 48)[i // 14 % 4], rng)
            at = rng.randrange(150)
            planted[i] = (len(" ".join(t[:at])) + (at > 0), k)
            t.insert(at, k)
        rows.append((i, " ".join(t)))
    out = by_id(secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), "scan")
    found = defaultdict(list)
    for i, (at, k) in planted.items():
        found[len(k)].append(any(int(x.split(":")[1]) <= at and int(x.split(":")[2]) >= at + len(k) for x in out[i][0]["spans"].split(",") if x))
    assert all(sum(x) >= 0.9 * len(x) for n, x in found.items() if n >= 24), {n: sum(x) / len(x) for n, x in found.items()}
    assert sum(map(sum, found.values())) >= 0.9 * len(planted)
    assert sum(x[0]["spans"] != "" for i, x in out.items() if i not in planted) <= 0.01 * len(planted)


def test_candidates_touch_no_base_span():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["secret=", "AKIA", "0af", " ", "Zq9", "-"]) * rng.randint(1, 9) for _ in range(30))
        base = secrets.base_spans(text)
        want = [m.span() for m in secrets.CANDIDATE.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b in base)]
        assert secrets.candidates(text, base) == want


# 6 n-gram join


def brute_components(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(d, []).append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            for x in sets[a]:
                for y in sets[b]:
                    o = len(x & y)
                    if x and y and 100 * o >= percent * (len(x) + len(y) - o):
                        p, q = find(a), find(b)
                        root[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}, sets


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_join_finds_every_link(docs, k, percent):
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").where("doc_id is not null").collect()]
    want, sets = brute_components(rows, k, percent)
    out = ngram_join.jaccard_components(docs, k, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None} == want
    assert len(out) == len(rows) + 1
    assert all(r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]} for r in out if r["doc_id"] is not None)
    assert len(set(want.values())) < len(want)


def test_fragments_lose_no_link():
    rng = np.random.default_rng(1)
    for percent in (90, 80):
        classes, links = ngram_join.Classes(percent), 0
        for _ in range(1500):
            x = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 300)), np.int64).astype(np.uint64) * np.uint64(2))
            o = len(x) - int(rng.integers(0, len(x) // 5 + 1))
            y = np.unique(np.concatenate([rng.permutation(x)[:o], rng.integers(0, 2**63, int(rng.integers(0, len(x) // 5 + 1)), np.int64).astype(np.uint64)]))
            if 100 * o < percent * (len(x) + len(y) - o):
                continue
            links += 1
            a, b = [(set(w.tolist()), n) for w, n in ngram_join.signatures(x, classes)], [(set(w.tolist()), n) for w, n in ngram_join.signatures(y, classes)]
            assert any(len(p & q) >= max(m, n) for p, m in a for q, n in b)
        assert links > 200


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_links_survive_a_half_similar_smaller_document(spark, parts):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows = []
    for i in range(0, 60, 3):  # the smallest id of three has half of the text, the others are near copies
        a = [word() for _ in range(200)]
        b = [*a[:197], *(word() for _ in range(3))]
        rows += [(i, " ".join([*a[:100], *(word() for _ in range(100))])), (i + 1, " ".join(a)), (i + 2, " ".join(b))]
    want, _ = brute_components(rows, 3, 90)
    assert all(want[i] == i and want[i + 2] == i + 1 for i in range(0, 60, 3))
    # By task: all three together, the first apart, each apart.
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parted = [df.where(F.array_contains(F.lit(list(x)), F.col("doc_id") % 3)).coalesce(1) for x in {1: ((0, 1, 2),), 2: ((0,), (1, 2)), 3: ((0,), (1,), (2,))}[parts]]
    every = parted[0]
    for p in parted[1:]:
        every = every.union(p)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(every, 3, 90).collect()} == want


def test_join_of_nothing(empty):
    assert ngram_join.jaccard_components(empty, 3, 90).count() == 0


def test_overlaps_in_fragments(monkeypatch):
    monkeypatch.setattr(ngram_join, "COLUMNS", 3)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, 20).astype(np.uint64)) for _ in range(8)]
    got = ngram_join.overlaps(sets[:5], sets[3:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[3:]] for a in sets[:5]]).all()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50, 90)] + [(200, x) for x in range(201, 240)] + [(5, 5), (None, 3), (7, 6), (7, 6)]
    out = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert out == {**{i: 50 for i in range(50, 91)}, **{i: 200 for i in range(200, 240)}, 6: 6, 7: 6}


# 7 language


def test_languages_of_held_out_texts(spark):
    rng = random.Random(4)
    syllables = {"aa": ["lo", "mi", "ra", "te"], "bb": ["sch", "ung", "er", "keit"], "cc": ["eau", "tion", "ou", "é"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(syllables))
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(20)), lang))
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "123 !!", "bb"), (1003, "lomi rate", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_x", F.lit(0))
    profiles = language_id.learn(df.where("doc_id % 4 <> 2"))
    out = {r["doc_id"]: r for r in language_id.predict_language(df, profiles).collect()}
    held = [r for r in rows[:300] if r[0] % 4 == 2]
    assert sum(out[i]["lang_pred"] == lang for i, _, lang in held) >= 0.97 * len(held)
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1000, 1001, 1002)) and out[1003]["lang_pred"] == "aa"
    none = language_id.learn(df.limit(0))
    assert {r["lang_pred"] for r in language_id.predict_language(df, none).collect()} == {"und"}


# 8 embeddings


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 2, (200, 8))
    p = embedding_dedup.decode(x)
    assert ((p * 2) % 1 == 0).all() and (p.sum(axis=1) % 2 == 0).all()
    best = np.min([((x - (p + r)) ** 2).sum(axis=1) for r in embedding_dedup.ROOTS], axis=0)
    assert (((x - p) ** 2).sum(axis=1) <= best + 1e-9).all() and len(embedding_dedup.ROOTS) == 240


def test_embedding_links(spark):
    rng = np.random.default_rng(3)
    rows, vectors = [], []
    for c in range(12):
        centre = rng.normal(size=64)
        for _ in range(15):
            vectors.append((centre + rng.normal(size=64) * rng.choice([0.02, 0.1, 0.14]), int(c % 3)))
    vectors += [vectors[0], vectors[0], (vectors[0][0] * 3, vectors[0][1])]
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, (v, lab) in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 64, 0), (n + 2, [float("nan")] * 64, 0), (n + 3, [None] * 64, 0), (n + 4, rows[0][1], None), (n + 5, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    x = np.array([r[1] for r in rows[:n]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows[:n]])
    hit = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(hit, False)
    got = np.array([out[i]["n_links"] for i in range(n)])
    assert (got <= hit.sum(axis=1)).all() and got.sum() >= 0.97 * hit.sum() > 0
    assert all(out[i]["n_links"] == 0 and out[i]["component_id"] == i and out[i]["kept"] for i in range(n, n + 6))
    assert out[n - 3]["component_id"] == 0 and not out[n - 3]["kept"]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# 9 sampled pieces


def test_pieces_round_trip_and_repeat(spark, docs, texts):
    df = docs.where("doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"])
    out = sampled_pieces.decode_pieces(sampled_pieces.encode_sampled(df, "doc_id")).collect()
    assert all(r["decoded"] == r["text"] for r in out)
    again = {r["doc_id"]: r["pieces"] for r in sampled_pieces.encode_sampled(df.repartition(7), "doc_id").collect()}
    assert {r["doc_id"]: r["pieces"] for r in out} == again
    other = {r["doc_id"]: r["pieces"] for r in sampled_pieces.encode_sampled(df, "doc_id", seed=2).collect()}
    assert other != again and again[texts.index("")] == [] and again[0] and again[texts.index(None)] is None
    assert all(r["lossless"] for r in sampled_pieces.encoded_digest(df, "doc_id").collect())


def test_segmentations_are_drawn_by_weight():
    lat = sampled_pieces.Lattice(sampled_pieces.vocabulary(), 0.3)
    weight = {p: lat.weight[i] for p, i in lat.pieces.items()}

    def ways(x):
        if not x:
            yield (), 1.0
        for k in range(1, len(x) + 1):
            if x[:k] in weight:
                for rest, v in ways(x[k:]):
                    yield (lat.pieces[x[:k]], *rest), weight[x[:k]] * v

    every = dict(ways("▁that"))
    total, n = sum(every.values()), 20_000
    seen = defaultdict(int)
    for ids in lat.sample_batch(["that"] * n, list(range(n))):
        seen[tuple(ids.tolist())] += 1
    assert set(seen) <= set(every)
    assert all(abs(seen[w] / n - v / total) < 0.015 for w, v in every.items())


# 10 toxicity


def test_toxicity_on_held_out_labels(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeghiklmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    bad = ["glorp", "zwick", "frunt"]
    rows, labels = [], []
    for i in range(900):
        t = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(2, 5)):
                t[rng.randrange(len(t))] = rng.choice(bad) + rng.choice(["", "er", "s"])
        rows.append((i, " ".join(t)))
        labels.append((i, None if i % 50 == 0 else int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "x" * 50_000)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(9)), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, lab.where("doc_id % 5 <> 0"))
    out = by_id(toxicity.score_toxicity(docs, model), "score")
    held = [(i, y) for i, y in labels if i % 5 == 0 and y is not None]
    assert sum((out[i][0] >= 0.5) == bool(y) for i, y in held) >= 0.95 * len(held)
    assert all(0 <= s[0] <= 1 for s in out.values()) and out[2001][0] < 0.5
    none = toxicity.train(docs.limit(0), lab.limit(0))
    assert all(s[0] < 0.5 for s in by_id(toxicity.score_toxicity(docs, none), "score").values())


def test_capitals_count_alike_at_every_length():
    at = toxicity.NAMES.index("upper_rate")
    for t in ("ПРИВЕТ МИР aa ", "ΑΒΓ δεζ ", "ŁÓDŹ ÉTÉ x ", "ABC def Ⅷ 𝐀 "):
        rate = sum(map(str.isupper, t)) / len(t)
        assert all(abs(toxicity.features(t * n, {})[at] - rate) < 1e-9 for n in (1, 10, 1000))


def test_isotonic_is_monotone_and_pools():
    v, y = np.array([1.0, 2, 3, 4, 5, 6]), np.array([0, 1, 0, 0, 1, 1])
    f = boosting.isotonic(v, y, smooth=0)
    got = f(np.linspace(0, 7, 50))
    assert (np.diff(got) >= -1e-12).all() and abs(f(np.array([3.0]))[0] - 1 / 3) < 1e-9 and got[-1] == 1


# the pipeline


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as P

    clean = docs.select(*P.COLUMNS).where("doc_id is not null").dropDuplicates(["doc_id"])
    clean.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert at.columns == list(P.COLUMNS), name
            path = str(tmp_path / name)
            at.write.parquet(path)
            at = spark.read.parquet(path)
            assert at.count() > 0
    assert at.count() > 0 and at.columns[:3] == ["doc_id", "start", "length"]
    left = spark.read.parquet(str(tmp_path / "secrets"))
    rows = [(r[0], r[1]) for r in spark.read.parquet(str(tmp_path / "near_duplicates")).select("doc_id", "text").collect()]
    want, _ = brute_components(rows, 5, 80)
    assert all(k == v for k, v in want.items()) and left.count() == len(rows)
    assert P.run(spark, str(tmp_path)).count() == at.count()
