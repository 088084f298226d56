"""Each operator against brute force on small tables, and the cases its docstring defines."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import common, decontam, graph, kdtree, licences, linededup, lm, neardup, packing, quality, registry, substrings, urls
from docloom.llm.queries import tokenizer_path
from docloom.llm.textops import ALNUM, NONSPACE, Words, text_bytes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    """Random texts with copies, near copies, shared passages, odd ones, nulls and repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    para = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [para(90) for _ in range(3)]
    texts = []
    for _ in range(n):
        lines = [para(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.3:
            lines.insert(rng.randint(0, len(lines)), rng.choice(shared))
        texts.append("\n".join(lines))
    texts += [texts[0], texts[1], texts[2].replace("a", "A"), " ".join(texts[3].split()[:-1]), texts[4] + " more"]
    texts += ["", " \n ", None, "one", "Two words", "x" * 3000, "\n".join([shared[0]] * 3), "ab " * 700, "🙂" * 300, "a\x1cb\x0bc"]
    rows = list(enumerate(texts))
    return rows + [rows[5], (None, "no id"), (6, "another text of id six")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def unique(rows):
    return [(i, t) for i, t in dict(reversed([r for r in rows if r[0] is not None])).items()]


EMPTY = "doc_id long, text string"


def test_words_match_patterns():
    texts = [t for _, t in corpus(3) if t is not None] + ["É́ Ab-c9_d", "A" * 10000 + " b"]
    data, off, _ = text_bytes(pa.array([t.translate(LOW) for t in texts]))
    for letters, pattern in ((ALNUM, ALNUM_WORDS), (NONSPACE, SPACE_WORDS)):
        w = Words(data, off, letters)
        got = defaultdict(list)
        for i, r in enumerate(w.row):
            got[r].append(w.word(i).decode())
        assert [got[k] for k in range(len(texts))] == [pattern.findall(t.translate(LOW)) for t in texts]
        by = defaultdict(set)
        for i, h in enumerate(w.hashes().tolist()):
            by[h].add(w.word(i))
        assert all(len(v) == 1 for v in by.values()) and len(by) == len({x for v in by.values() for x in v})


# licences


def test_licence_scan(spark):
    mit = dict(licences.KNOWN)["MIT"] if False else next(t for i, t in licences.KNOWN if i == "BSD-2-Clause")
    texts = ["Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + mit.upper().replace("LICENSE", "LICENCE"), mit + " extra", "", "...", None, "Released under the MIT Licence"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id int, text string, digest string, licence_text string")
    out = {r["doc_id"]: r for r in licences.scan(df).collect()}
    assert [out[i]["licence_id"] for i in range(6)] == ["BSD-2-Clause", None, None, None, None, "MIT"]
    assert out[4]["digest"] is None and out[2]["digest"] == out[3]["digest"] != "x"
    assert licences.scan(df.limit(0)).count() == 0


# line dedup


def brute_lines(rows, least):
    kept = sorted({(i, t) for i, t in rows if i is not None and t is not None}, key=lambda r: (r[0], r[1]))
    seen, gone = {}, defaultdict(set)
    for i, t in kept:
        lines = [(k, x) for k, x in enumerate(t.split("\n")) if x.strip(" ")]
        for p in range(len(lines)):
            size = 0
            for q in range(p, len(lines)):
                size += len(lines[q][1])
                if size >= least:
                    run = tuple(x for _, x in lines[p : q + 1])
                    if run in seen:
                        gone[i, t] |= {k for k, _ in lines[p : q + 1]}
                    else:
                        seen[run] = i
                    break
    return {(i, t): "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t]) for i, t in kept}


@pytest.mark.parametrize("least", [1, 40, 300])
def test_line_dedup(docs, rows, least):
    rows = [r for r in rows if not (r[0] == 6 and r[1] and r[1].startswith("another"))]  # ties of one id go by a hash
    df = docs.where("NOT coalesce(text LIKE 'another%', false)").withColumn("spans", F.lit(1)).withColumn("removed_runs", F.lit("x")).withColumn("old", F.col("text"))
    out = linededup.dedup_lines(df, min_chars=least).collect()
    want = brute_lines(rows, least)
    assert len(out) == len(rows) and all(r["spans"] == 1 for r in out)
    for r in out:
        assert r["text"] == (want[r["doc_id"], r["old"]] if r["doc_id"] is not None and r["old"] is not None else r["old"])


def brute_whole(rows, least):
    """Every run of lines from everywhere, as the rule says."""
    kept = sorted({(i, t) for i, t in rows if i is not None and t is not None}, key=lambda r: (r[0], r[1]))
    seen, gone = {}, defaultdict(set)
    for n, (i, t) in enumerate(kept):
        lines = [(k, x) for k, x in enumerate(t.split("\n")) if x.strip(" ")]
        for p in range(len(lines)):
            for q in range(p, len(lines)):
                run = tuple(x for _, x in lines[p : q + 1])
                if sum(map(len, run)) >= least and seen.setdefault(run, (n, p)) != (n, p):
                    gone[i, t] |= {k for k, _ in lines[p : q + 1]}
    return {(i, t): "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t]) for i, t in kept}


@pytest.mark.parametrize("least", [1, 40, 300])
def test_line_dedup_of_whole_runs(spark, rows, least):
    rng = random.Random(6)
    a, b = "a" * 100, "b" * 20
    texts = [f"{a}\n{b}\nleft", f"{a}\n\n{b}\nright", f"{b}\nelse"] + ["\n".join("x" * rng.choice([1, 2, 9, 17, 30]) for _ in range(rng.randint(1, 14))) for _ in range(40)]
    data = [r for r in rows if r[0] is not None and not (r[0] == 6 and r[1].startswith("another"))] + [(100 + k, t) for k, t in enumerate(texts)]
    out = linededup.dedup_lines(spark.createDataFrame(data, EMPTY).withColumn("old", F.col("text")), min_chars=least, whole=True).collect()
    want = brute_whole(data, least)
    assert len(out) == len(data)
    for r in out:
        assert r["text"] == (want[r["doc_id"], r["old"]] if r["old"] is not None else None)
    if least == 40:
        assert {r["doc_id"]: r["text"] for r in out}[101] == "\nright"


def test_line_dedup_of_nothing(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], EMPTY)).count() == 0


# top-k


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(300)]
    vectors += [(i, [1.0] * 8) for i in range(300, 360)] + [(400, None), (401, [float("nan")] * 8), (402, [None] + [1.0] * 7), (403, [float("inf")] * 8), (None, [1.0] * 8), (404, [1.0, 2.0]), (420, [0.5, 1.0]), (300, [1.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").select(F.col("vec_id").alias("id"), kdtree.whole_numbers("embedding").alias("v"))
    got = defaultdict(list)
    for r in kdtree.top_k(df, df.where("id % 20 = 0"), k=20, shard=100, block=5, leaf=8).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, np.floor(64 * np.array(v, float))) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    for q, x in {i: v for i, v in good if i % 20 == 0}.items():
        scores = sorted(((-int(x @ v), i) for i, v in good if i != q and len(v) == len(x)))[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    none = df.limit(0)
    assert kdtree.top_k(none, none).count() == 0


# decontamination


def brute_scan(rows, items, window=13):
    sets = defaultdict(set)
    for i, t in items:
        w = ALNUM_WORDS.findall((t or "").translate(LOW))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            sets[tuple(w[k : k + n])].add(i)
    out = []
    for i, t in rows:
        w = ALNUM_WORDS.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(k) for k in sets}:
            for k in range(len(w) - n + 1):
                if owners := sets.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= owners
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_decontamination(spark, docs, rows, block):
    items = [(1, " ".join(rows[0][1].split()[:20])), (2, "Two, WORDS!"), (3, None), (4, "..."), (10, rows[1][1]), (2, "two words"), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.digest(decontam.scan(docs.withColumn("n_hit", F.lit("clash")), bench, block_bytes=block)).collect()
    want = brute_scan(rows, [x for x in items if x[0] is not None])
    assert Counter(tuple(r) for r in got) == Counter(want)
    left = decontam.drop_documents(docs, bench)
    assert left.count() == sum(not w[-1] for w in want) and left.columns == docs.columns
    cut = decontam.remove_spans(docs, bench)
    assert cut.count() == len(rows) and decontam.scan(cut, bench).where("doc_id = 1 AND n_hit > 0").count() == 0
    assert decontam.scan(docs.limit(0), bench).count() == 0 and decontam.scan(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


# packing


def test_packing_round_trip(spark, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    odd = [(900, "It's O'Neil's don't ''re 'S ,'s"), (901, "x<|endoftext|>y <|ENDOFTEXT|> abc"), (902, "e\u0301 =\u0338 a\u00a0b\u2003c \u01c5 İ ς Σ"), (903, "word " * 5000), (904, "a1b22c!!d--e'f\u2019g")]
    data = [(i, x, 1) for i, x in enumerate(x for _, x in [*rows, *odd])]
    df = spark.createDataFrame(data, "doc_id long, text string, piece int").repartition(3)
    out = packing.pack(df, tokenizer_path(), keep_ids=True, length=128, most_open=4).collect()
    whole = defaultdict(list)
    for r in out:
        whole[r["doc_id"]].append(r)
    for i, x, _ in data:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        parts = sorted(whole[i], key=lambda r: r["piece"])
        assert [k for p in parts for k in p["ids"]] == ids
        assert all(p["start"] == 128 * k and p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for k, p in enumerate(parts))
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 128
    assert len(places) <= 1.1 * -(-sum(r["length"] for r in out) // 128) + 2
    assert packing.pack(df.limit(0), tokenizer_path()).count() == 0


# quality


def test_estimate_finds_the_bad_labeller():
    rng = random.Random(2)
    counts = Counter()
    for _ in range(4000):
        bad = rng.random() < 0.2
        votes = [2, *(0 if bad and rng.random() < p else 1 for p in (0.8, 0.7, 0.9)), rng.choice([0, 1]) if bad else 1]
        counts[sum(v * 3**k for k, v in enumerate(votes))] += 1
    bad, theta, share = quality.estimate(dict(counts), 5)
    assert share == pytest.approx(0.2, abs=0.05)
    assert theta[3][1][0] > theta[2][1][0] > theta[4][1][0]
    assert quality.estimate({}, 3) == ({}, [], 0.0)


def test_quality_classifier(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, truth = [], {}
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        kind = rng.choice(["good"] * 4 + ["caps", "signs", "toxic"])
        if kind == "toxic":
            for k in range(0, len(w), 10):
                w[k] = rng.choice(quality.INSULTS)
        text = {"caps": lambda: "!! ".join(w).upper(), "signs": lambda: "$$$ ".join(w)}.get(kind, lambda: " ".join(w) + ".")()
        rows.append((i, text, "p"))
        truth[i] = kind
    rows += [(1000, None, "p"), (1001, "", "p"), (1002, "...", "p"), (None, "some words here.", "p"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(k not in ("caps", "signs")), int(k == "toxic")) for i, k in truth.items() if i % 3 == 0] + [(0, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["kept"] for r in quality.score(df, quality.train(df, labels)).collect()}
    right = sum(out[i] == (k == "good") for i, k in truth.items() if i)
    assert right >= 0.98 * (len(truth) - 1)
    assert not out[1000] and not out[1001]
    assert quality.score(df, quality.train(df)).count() == len(rows)
    none = df.limit(0)
    assert quality.score(none, quality.train(none, labels)).count() == 0


# language models


def test_lm_prefers_the_target(spark):
    rng = random.Random(9)
    a, b = ([f"{c}{k}" for k in range(8)] for c in "ab")
    rows = [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(60)), "s") for i in range(200)] + [(500, None, "s"), (501, "", "s"), (502, "?!", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    target = spark.createDataFrame([(i,) for i in range(1, 120, 2)] + [(None,), (9999,)], "id long")
    out = {r["doc_id"]: r for r in lm.score(df, lm.train(df, target)).collect()}
    assert all(out[i]["score"] < 0 for i in range(121, 200, 2)) and all(out[i]["score"] > 0 for i in range(0, 200, 2))
    assert out[500]["score"] is out[501]["score"] is out[502]["score"] is None and out[502]["n_words"] == 0
    assert lm.score(df.limit(0), lm.train(df, target.limit(0))).count() == 0


def test_lm_losses_are_those_of_plain_counts(spark):
    rows = [(1, "a b a b c"), (2, "a b c"), (3, "c c a")]
    df = spark.createDataFrame(rows, EMPTY)
    model = lm.train(df, spark.createDataFrame([(2,)], "id long"))
    got = {r["doc_id"]: r["target_loss"] for r in lm.score(df, model).collect()}
    # the target is document 2: three words, each once; pairs ^a, ab, bc once
    single = lambda w: ({"a": 1, "b": 1, "c": 1}[w] + lm.UNIFORM) / (3 + lm.UNIFORM * 3)
    pairs, before = {("^", "a"): 1, ("a", "b"): 1, ("b", "c"): 1}, {"^": 1, "a": 1, "b": 1}
    for i, t in rows:
        w = t.split()
        loss = [-np.log((pairs.get((p, x), 0) + lm.FALLBACK * single(x)) / (before.get(p, 0) + lm.FALLBACK)) for p, x in zip(["^", *w], w)]
        assert got[i] == pytest.approx(np.mean(loss), abs=1e-5)


def plain_losses(rows, marked):
    """Both losses of each text by counts over the words themselves."""
    cut = {i: ALNUM_WORDS.findall((t or "").translate(LOW)) for i, t in rows}
    words, pairs, before = ([Counter(), Counter()] for _ in range(3))
    for i, w in cut.items():
        for k in (0, 1) if i in marked else (0,):
            words[k].update(w)
            pairs[k].update(zip(["^", *w], w))
            before[k].update(["^", *w][: len(w)])
    total, vocabulary = [sum(c.values()) for c in words], len(words[0])
    scale = [total[1] / total[0], 1.0]

    def loss(k, b, w):
        single = (words[k][w] * scale[k] + lm.UNIFORM) / (total[k] * scale[k] + lm.UNIFORM * vocabulary)
        return -np.log((pairs[k][b, w] * scale[k] + lm.FALLBACK * single) / (before[k][b] * scale[k] + lm.FALLBACK))

    return {i: tuple(np.mean([loss(k, b, x) for b, x in zip(["^", *w], w)]) for k in (1, 0)) for i, w in cut.items() if w}


@pytest.mark.parametrize("small", [common.BROADCAST_BYTES, 0])
def test_lm_counts_more_ngrams_than_any_fixed_table(spark, small, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", small)
    rng = random.Random(12)
    rows = [(i, " ".join(f"É{rng.randrange(400_000)}" for _ in range(6000))) for i in range(150)]
    rows.append((150, rows[0][1]))
    df = spark.createDataFrame(rows, EMPTY).repartition(4).cache()
    marked = set(range(0, 150, 3))
    out = lm.score(df, lm.train(df, spark.createDataFrame([(i,) for i in marked], "id long"))).collect()
    want = plain_losses(rows, marked)
    assert len(out) == 151 and all(r["n_words"] == 6000 for r in out)
    for r in out:
        assert (r["target_loss"], r["background_loss"]) == pytest.approx(want[r["doc_id"]], abs=2e-6)
        assert r["score"] == pytest.approx(r["target_loss"] - r["background_loss"], abs=1e-9)


def test_lm_scores_texts_that_it_has_not_counted(spark):
    rows = [(1, "a b a b c"), (2, "a b c"), (3, "c c a")]
    df = spark.createDataFrame(rows, EMPTY)
    model = lm.train(df, spark.createDataFrame([(2,)], "id long"))
    assert df.select(F.col("text").cast("string").alias("text")).sameSemantics(model.texts)
    new = {r["doc_id"]: r for r in lm.score(spark.createDataFrame([(1, "a zz"), (2, "a b c"), (3, None)], EMPTY), model).collect()}
    uniform = lm.UNIFORM / (3 + lm.UNIFORM * 3)
    first = (1 + lm.FALLBACK * (1 + lm.UNIFORM) / (3 + lm.UNIFORM * 3)) / (1 + lm.FALLBACK)
    assert new[1]["target_loss"] == pytest.approx(-np.log([first, lm.FALLBACK * uniform / (1 + lm.FALLBACK)]).mean(), abs=2e-6)
    assert new[2]["target_loss"] == {r["doc_id"]: r["target_loss"] for r in lm.score(df, model).collect()}[2]
    assert new[3]["n_words"] == 0 and new[3]["score"] is None


# urls


def test_url_rules(spark):
    cases = [
        ("https://www.Example.COM/en/1?q#f", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("http://example.com/de", "example.com", "/de", "com/", "allow"),
        ("http://xcom/de", "xcom", "/de", None, None),
        ("http://a.net/es/", "a.net", "/es/", "net/es/", "block"),
        ("http://a.net?x=/es/", "a.net", "", None, None),
        ("http://example.com", "example.com", "", None, None),
        ("nothing", "", "", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
        ("a://b://c.com/x", "b:", "//c.com/x", None, None),
        ("http://u:p@H.com:80/a/../b", "u:p@h.com:80", "/a/../b", None, None),
    ]
    df = spark.createDataFrame([(k, c[0], "x") for k, c in enumerate(cases * 3)], "page_id int, url string, rule string")
    out = {r["page_id"]: r for r in urls.judge(df, trees=2, least=1).collect()}
    for k, c in enumerate(cases * 3):
        assert (out[k]["host"], out[k]["path"], out[k]["rule"]) == c[1:4]
        assert out[k]["verdict"] == c[4] or c[4] is None and out[k]["verdict"] in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.judge(df.where("url = 'nothing'")).collect()} == {"allow"}


def test_url_trees_learn(spark):
    rows = [(k, f"http://h{k}.zz/{'b' if k % 3 == 0 else 'a'}/" + "1" * (20 if k % 3 == 0 else k % 5)) for k in range(300)]
    df = spark.createDataFrame(rows, "page_id int, url string")
    out = urls.judge(df, [("block", "zz/b/"), ("allow", "zz/a/1")]).where("rule IS NULL")
    assert {r["verdict"] for r in out.collect()} == {"allow"}


def plain_trees(rows, names, edges, trees, depth, rate, ridge, least):
    """Log-odds of each row by boosted trees grown row by row."""
    bins = [{c: sum(r[c] >= e for e in edges[c]) for c in names} for r in rows]
    y = np.array([r["_y"] for r in rows], float)
    score = np.full(len(rows), np.log(y.sum() / (len(y) - y.sum())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)

        def grow(at, level, g=g, h=h):
            best = None
            if level < depth:
                for c in names:
                    for b in sorted({bins[i][c] for i in at})[:-1]:
                        low = [i for i in at if bins[i][c] <= b]
                        if min(len(low), len(at) - len(low)) < least:
                            continue
                        gl, hl, ga, ha = g[low].sum(), h[low].sum(), g[at].sum(), h[at].sum()
                        gain = gl * gl / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga * ga / (ha + ridge)
                        if gain > 1e-3 and (best is None or gain > best[0] + 1e-9):
                            best = gain, c, b
            if best is None:
                score[at] += rate * g[at].sum() / (h[at].sum() + ridge)
                return
            for side in ([i for i in at if bins[i][best[1]] <= best[2]], [i for i in at if bins[i][best[1]] > best[2]]):
                grow(side, level + 1)

        grow(list(range(len(rows))), 0)
    return score


def test_url_trees_are_those_of_plain_boosting(spark):
    rng = random.Random(6)
    names = ["u", "v", "w"]
    rows = [{c: float(round(rng.random() * 8, 2)) for c in names} for _ in range(400)]
    for r in rows:
        r["_y"] = int(r["u"] + 2 * (r["v"] > 4) + rng.random() * 2 > 6)
    df = spark.createDataFrame([tuple(r[c] for c in (*names, "_y")) for r in rows], "u double, v double, w double, _y long").repartition(3)
    model = urls.train(df, names, trees=4, depth=3)
    got = {(r["u"], r["v"], r["w"]): r["s"] for r in df.select(*names, model.score({c: model.bin(c, F.col(c)) for c in names}).alias("s")).collect()}
    want = plain_trees(rows, names, model.edges, 4, 3, 0.4, 1.0, 20)
    assert all(abs(got[r["u"], r["v"], r["w"]] - s) < 1e-4 for r, s in zip(rows, want.tolist(), strict=True))
    assert len(model.trees) == 4 and any(t["splits"] for t in model.trees)


# near duplicates


def brute_near(rows, size=5, percent=75):
    sets = []
    for _, t in rows:
        w = SPACE_WORDS.findall((t or "").translate(LOW))
        n = min(size, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least[r] is None else min(least[r], i)
    return Counter((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def test_near_duplicates(spark, rows):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    near = []
    for i in range(200, 260):  # a group of near copies larger than a short list
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(50)}"
        near.append((i, " ".join(w)))
    data = [r for r in rows if r[0] is not None] + near
    df = spark.createDataFrame(data, EMPTY).withColumn("n", F.lit(1))
    got = neardup.near_duplicates(df)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_near(data)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_at_the_threshold(spark):
    rows = []
    for i in range(500):  # 90 of 120 shingles: sketches that reach the upper half of the hashes
        w = [f"p{i}x{k}" for k in range(124)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:94]))]
    out = neardup.near_duplicates(spark.createDataFrame(rows, EMPTY).repartition(4)).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out} == {(i, 90 if i % 2 else 120, i - i % 2) for i, _ in rows}


def test_keep_one(spark):
    df = spark.createDataFrame([(3, "a b c d e f", 1), (1, "A b c d  e f", 2), (2, "other words", 3), (4, None, 4)], "doc_id long, text string, kept int")
    out = neardup.keep_one(df)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 4] and out.columns == df.columns


def test_keep_one_loses_no_text_where_ids_or_rows_repeat(spark):
    a, b, c = "a b c d e f", "x y z u v w", "k l m n o p q"
    rows = [(1, a), (1, a), (1, b), (2, a), (3, b), (3, c), (4, ""), (4, ""), (None, c), (5, None)]
    got = sorted((r["doc_id"], r["text"] or "") for r in neardup.keep_one(spark.createDataFrame(rows, EMPTY).repartition(3)).collect())
    assert got == [(1, a), (1, b), (3, c), (4, ""), (4, ""), (5, "")]


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_in_large_groups(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(3):  # copies of one text, some alike enough to it, some only to another copy, some to none
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([60, 90, 150]))]
        for _ in range(70):
            w = list(base)
            for _ in range(rng.randint(0, len(base) // 14)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(30)}"
            if rng.random() < 0.3:
                w = w[: rng.randrange(len(w) // 2, len(w))] + [f"y{rng.randrange(9)}"] * rng.randint(0, 9)
            rows.append((len(rows), " ".join(w)))
    words = [f"c{k}" for k in range(400)]
    for k in range(60):  # a chain: each is like the next only
        rows.append((len(rows), " ".join(words[5 * k : 5 * k + 50])))
    got = neardup.near_duplicates(spark.createDataFrame(rows, EMPTY).repartition(4))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_near(rows)


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 220)] + [(0, k) for k in range(1, 60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(500, 500)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent if top(x) != x}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_without_an_id(spark):
    a, b, line = "a b c d e f", "x y z u v w", "l" * 50
    df = spark.createDataFrame([(1, a), (None, a), (None, b), (2, b + " t")], EMPTY)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()}
    assert got == {(1, 2, 1, True), (None, 2, 1, False), (None, 2, None, True), (2, 3, 2, True)}
    assert sorted((r["doc_id"] or 0, r["text"]) for r in neardup.keep_one(df).collect()) == [(0, b), (1, a), (2, b + " t")]
    df = spark.createDataFrame([(None, line), (5, line), (None, line), (6, line)], EMPTY)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in linededup.dedup_lines(df).collect()) == [(0, line), (0, line), (5, line), (6, "")]


# substrings


def brute_substrings(rows, length):
    count = Counter()
    raw = [(t or "").encode() for _, t in rows]
    for b in raw:
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("length", "chunk"), [(400, 2048), (100, 2), (64, 1)])
def test_substring_dedup(spark, rows, length, chunk, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    monkeypatch.setattr(substrings, "SEGMENT", 1500)  # so that some texts are handled in pieces
    df = spark.createDataFrame(rows, EMPTY).withColumn("n_removed", F.lit("clash"))
    out = substrings.dedup_substrings(df, length=length)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()) == brute_substrings(rows, length)
    assert substrings.dedup_substrings(df.limit(0)).count() == 0


def morse(n, swap):
    """Blocks in the order of the Thue-Morse sequence, on which polynomial hashes modulo a power of two collide."""
    return "".join("Xp9d" if (bin(i).count("1") + swap) % 2 else "MaRs" for i in range(n))


def test_substring_dedup_tells_texts_apart_that_simple_hashes_do_not(spark):
    rng = random.Random(8)
    pad = lambda: "".join(rng.choice("abcdefghij") for _ in range(205))
    a, b = pad(), pad()
    rows = [(1, a + morse(16, 0) + b), (2, a + morse(16, 1) + b), (3, morse(2048, 0)), (4, morse(2048, 1)), (5, "ab" * 3000), (6, "x" * 401)]
    out = substrings.dedup_substrings(spark.createDataFrame(rows, EMPTY))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect())
    assert got == brute_substrings(rows, 400)
    assert {i: n for i, _, n, *_ in got}[1] == 0


def test_substring_dedup_goes_by_bytes_not_by_words(spark, tmp_path):
    rng = random.Random(10)
    words = lambda size, n: " ".join("".join(rng.choice("abcdefghij") for _ in range(k + 1)) for k in np.diff(np.linspace(0, size + 1, n + 1).astype(int)) - 2)
    short, long = words(399, 60), words(400, 60)
    rows = [(1, "A " + short + " A"), (2, "B" + short + "B"), (3, "C" + long + "C"), (4, "D" + long + "D"), (5, words(500, 80))]
    assert (len(short), len(long), len(short.split()), len(long.split())) == (399, 400, 60, 60)
    spark.createDataFrame(rows, EMPTY).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in registry.queries()["op10_suffix_array_dedup"](spark, str(tmp_path)).collect()}
    left = {i: {3: "CC", 4: "DD"}.get(i, t) for i, t in rows}
    assert got == {i: (len(t), len(t) - len(left[i]), hashlib.sha256(left[i].encode()).hexdigest()) for i, t in rows}


@pytest.mark.parametrize("seed", range(6))
def test_interleave_refinement(seed):
    rng = random.Random(seed)
    length, contexts, groups = 12, [], []
    for g in range(5):
        base = "".join(rng.choice("ab") for _ in range(60))
        for _ in range(rng.randint(1, 9)):
            text = "".join(c if rng.random() < 0.95 else rng.choice("abc") for c in base)
            b = rng.randint(0, 10)
            e = rng.randint(max(1, length - b), length)
            contexts.append((text[20 - b : 20 + e].encode(), b))
            groups.append(g)
    data = np.frombuffer(b"".join(t for t, _ in contexts), np.uint8)
    size = np.array([len(t) for t, _ in contexts])
    before = np.array([b for _, b in contexts])
    which, far = substrings.repeats(data, np.cumsum(size) - size + before, before, size - before, np.array(groups), length)
    seen = defaultdict(list)
    for i, (t, b) in enumerate(contexts):
        for s in range(min(b, len(t) - length) + 1):
            seen[groups[i], b - s, t[s : s + length]].append((i, b - s))
    assert sorted(zip(which.tolist(), far.tolist(), strict=True)) == sorted(x for v in seen.values() if len(v) > 1 for x in v)


# the pipeline


def test_pipeline_is_its_stages(spark, tmp_path, rows):
    import corpus_pipeline as P

    rng = random.Random(3)
    good = [(i, t if t is None else t + ".", "en", "s", len(t or "")) for i, t in rows if i is not None and i != 6 and i != 5][:60]
    good.append((700, " ".join(rng.choice(["SHOUT", "LOUD"]) + f"{k}!!" for k in range(80)), "en", "s", 1))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(good, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Two words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (700, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = P.quality_classifier(spark, docs, str(tmp_path))
    ids = {r["doc_id"] for r in kept.collect()}
    assert 700 not in ids and len(ids) > 50 and kept.columns == docs.columns
    now = [(r["doc_id"], r["text"]) for r in kept.collect()]
    lines = brute_lines(now, linededup.MIN_CHARS)
    now = [(i, lines[i, t] if t is not None else None) for i, t in now]
    least = {i: c for i, _, c in brute_near(now)}
    now = [(i, t) for i, t in now if least[i] == i]
    bad = {r[0] for r in brute_scan(now, [(1, "Two words")]) if r[-1]}
    want = {i for i, _ in now if i not in bad}
    out = P.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == want


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_on_odd_tables(spark, tmp_path, empty):
    import corpus_pipeline as P

    clash = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, spans string, digest long"
    rng = random.Random(4)
    prose = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(k)) + "."
    texts = [prose(40) for _ in range(12)]
    rows = [] if empty else [(i if i != 3 else None, t, "en", "s", len(t), "k", "w", None, 7) for i, t in enumerate([*texts, texts[0], texts[0]])]
    for name, data, schema in (("documents", rows, clash), ("benchmark", [], "item_id long, text string"), ("labels", [], "doc_id long, quality int, toxic int")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    out = P.run(spark, str(tmp_path)).collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in out) == ([] if empty else [-1, *(i for i in range(14) if i != 3)])
    # the two later copies lost their only line before, and texts without words all stay
    assert sum(r["length"] == 1 for r in out) == (0 if empty else 2)
