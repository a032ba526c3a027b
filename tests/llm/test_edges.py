"""Odd inputs of every operator and stage, fitted models, and methods against brute force."""

import hashlib
import os
import random
import re
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsift.llm import bpe, common, decontam, langid, pii, quality, secrets, substring, topk, toxicity
from flowsift.llm import simhash
from flowsift.llm.registry import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, g long, node long, blob string, score double, h long, y int"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def docs(spark, rows):
    """Rows (doc_id, text) with many extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, "b", 0.5, 3, 1) for i, t in rows], DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(21)
    long = words(rng, 60_000, 3000)
    mail = "write to me@x.org, password: hunter2hunter2, you idiot"
    return [(1, mail), (1, mail), (1, "another text under the same id"), (2, None), (3, ""), (4, " \n\t "), (5, long), (None, mail), (None, mail), (None, None), (6, "é" * 30), (7, "12 34 !?")]


@pytest.fixture(scope="module")
def models(spark):
    d = "/root/testdata/sf0.001"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return quality.fit(table, labels), toxicity.fit(table, labels), langid.fit(table)


def outcomes(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_a_row_for_each_document_whatever_it_holds(spark, odd, models):
    q, t, lang = models
    each = {
        "quality": lambda d: quality.score(d, q), "toxicity": lambda d: toxicity.score(d, t), "language": lambda d: langid.predict(d, lang),
        "secrets": secrets.findings, "pii": pii.digests, "bpe": lambda d: bpe.digests(d, tokenizer_file()), "substring": substring.digests, "simhash": simhash.near_duplicates,
    }
    for name, run in each.items():
        got = run(docs(spark, odd)).toPandas()
        assert len(got) == len(odd), name
        assert got["doc_id"].isna().sum() == 3, name
        same = got[got["doc_id"] == 1].drop_duplicates()
        assert len(same) <= 2 + (name == "substring"), name  # repeated rows have one outcome
        empty = run(docs(spark, [])).toPandas()
        assert len(empty) == 0 and list(empty.columns) == list(got.columns), name
        if "score" in got:
            assert got["score"].between(0, 1).all(), name
        if "held_out" in got:
            assert not got["held_out"][got["doc_id"].isna()].any(), name


def test_models_of_tables_without_what_they_need(spark, odd, models):
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (5, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    table = docs(spark, odd)
    assert toxicity.fit(table, labels) is None and len(toxicity.score(table, None).where("score = 0").collect()) == len(odd)
    assert quality.fit(table, labels.where("false")) is None
    assert quality.score(table, quality.fit(table, labels)).count() == len(odd)
    assert {r.lang_pred for r in langid.identify(docs(spark, [])).collect()} == set()
    nothing = spark.createDataFrame([(1, "ab cd", None), (None, "ab", "xx")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(nothing).collect()} <= {"und", "xx"}


def test_links_in_workers_that_did_nothing_else():
    script = f"""
import sys, tempfile
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
t = tempfile.mkdtemp(prefix="spark-")
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.local.dir", t).config("spark.checkpoint.dir", t + "/c").getOrCreate()
from flowsift.llm import simhash
rows = s.createDataFrame([(bytearray((i // 2 * 0x0101010101010101 % 2**64 ^ i % 2).to_bytes(8, "big")), i) for i in range(64)], "fp binary, node long")
print("links", simhash.links(rows, simhash.covering_triples(), 4, 4).distinct().count())
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": ROOT})
    assert "links 32" in done.stdout, done.stderr[-2000:]


def test_common_keys_are_dealt_into_shares(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 10)
    rows = spark.createDataFrame([("a" if i % 3 else f"k{i}", i) for i in range(90)], "k string, i long")
    few = spark.createDataFrame([("a", "A"), ("k0", "zero")], "k string, v string")
    got = common.join_hot(rows, few, "k", "i", "left").toPandas()
    assert len(got) == 90 and (got["v"] == "A").sum() == 60 and (got["v"] == "zero").sum() == 1
    assert common.join_hot(rows, few, "k", "i").count() == 61


def test_folders_have_to_be_shared(spark, monkeypatch):
    class Bare:
        sparkContext = property(lambda self: self)
        getCheckpointDir = lambda self: None
        getConf = lambda self: {}

    with pytest.raises(RuntimeError):
        common.checkpoints(Bare())


# ---------------------------------------------------------------- classifiers
def test_risk_of_positives_and_unlabelled_texts():
    rng = np.random.default_rng(1)
    zp, zu, w = rng.normal(1, 1, (60, 5)), rng.normal(0, 1, (90, 5)), rng.normal(0, 0.5, 5)
    for part in (0, 1):
        numeric = [(quality.pu_risk(w + e, zp, zu, 0.6)[part] - quality.pu_risk(w - e, zp, zu, 0.6)[part]) / 2e-6 for e in np.eye(5) * 1e-6]
        assert np.allclose(quality.pu_gradients(w, zp, zu, 0.6)[part], numeric, atol=1e-5)
    n = quality.N_FEATURES
    make = lambda m, shift: np.c_[rng.normal(shift, 0.3, (m, n - 1)), np.ones(m)]
    p, u = make(800, 1.0), np.r_[make(700, 1.0), make(300, 0.0)]
    prior = quality.estimate_prior(p, u)
    assert abs(prior - 0.7) < 0.06
    model = quality.fit_pu(p, u, prior)
    start = sum(quality.pu_risk(model.w * 0, model.rows(p), model.rows(u), prior))
    assert sum(quality.pu_risk(model.w, model.rows(p), model.rows(u), prior)) < start
    good, bad = model.score(make(200, 1.0)), model.score(make(200, 0.0))
    assert (good >= 0.7).mean() > 0.97 and (bad >= 0.7).mean() < 0.03


def test_quality_never_sees_labelled_negatives(spark):
    d = "/root/testdata/sf0.001"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    one, other = quality.fit(table, labels), quality.fit(table, labels.where("quality = 1"))
    assert np.allclose(one.w, other.w) and one.prior == other.prior


def test_classifiers_on_small_label_tables(spark, models):
    d = "/root/testdata/sf0.001"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    q, t, _ = models
    for got, name in ((quality.score(table, q), "quality"), (toxicity.score(table, t), "toxic")):
        rows = got.join(labels, "doc_id").toPandas()
        assert rows["score"].nunique() > 50  # no constant score, however few labels there are
        assert (rows["predicted"] == rows[name]).mean() > 0.85


def test_toxicity_is_learned_from_sentences(spark):
    rng = random.Random(5)
    insults = ["moron", "idiot", "scumbag"]
    rows, labels = [], []
    for i in range(400):
        parts = [words(rng, 8, 300) for _ in range(6)]
        if i % 4 == 0:
            parts[rng.randrange(6)] += " " + rng.choice(insults)
        rows.append((i, ". ".join(parts)))
        labels.append((i, int(i % 4 == 0)))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), known)
    texts = ["w1 w2. you m-o-r-o-n w3", "an i d i o t here", "what a scumm-bag. w7", "w5 w6 w7. w8 w9", "", None]
    score = model.score(texts)
    assert (score[:3] >= 0.5).all() and (score[3:] < 0.5).all()
    got = toxicity.score(docs(spark, rows), model).join(known, "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got["predicted"] == got["toxic"]).mean() > 0.95
    bags = [np.array([[0.1, 0.0], [0.9, 0.1]]), np.array([[0.8, 0.0]]), np.array([[0.0, 0.9], [0.1, 0.0]]), np.array([[0.1, 0.8]])]
    v, bias = toxicity.witnesses(bags, np.array([1, 1, 0, 0]), np.eye(2))
    assert [(b @ v).max() + bias > 0 for b in bags] == [True, True, False, False]


def test_language_ties_and_shares(spark):
    rows = [(i, "ka ko" if i % 2 else "ka ko", ("aa", "bb")[i % 2]) for i in range(400)] + [(9000 + i, "zu ze", "cc") for i in range(8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sampled = langid.learning_rows(table, 60).groupBy("lang").count().toPandas().set_index("lang")["count"]
    assert sampled["aa"] < 60 and sampled["bb"] < 60 and sampled["cc"] >= 3  # rare languages aren't crowded out
    m = langid.Model(["aa", "bb"], ["x"], np.log(np.array([[0.5, 0.5]], np.float32)), ["y"], np.log(np.array([[0.4, 0.6]], np.float32)))
    assert m.predict("x x") == ("aa", 0.5)  # a tie goes to the first by name
    lang, one = m.predict("y")
    assert lang == "bb" and 0.5 < one < m.predict("y y y y")[1] < 1


# ---------------------------------------------------------------- decontamination, personal data, search, tokens
def brute_similarity(text, item):
    """The best weighted similarity over windows of the item's size that share a shingle with it in place."""
    w, x = text.lower().split(), item.lower().split()
    size = min(5, len(x))
    grams = lambda v: [tuple(v[i : i + size]) for i in range(len(v) - size + 1)]
    ig, best = grams(x), 0.0
    for start in {p - o for p, g in enumerate(grams(w)) for o, h in enumerate(ig) if g == h}:
        wg = grams(w[max(start, 0) : max(start, 0) + min(start + len(x), len(w)) - max(start, 0)])
        common = sum(min(wg.count(g), ig.count(g)) for g in set(ig))
        best = max(best, common / (len(wg) + len(ig) - common))
    return best


def test_fingerprints_find_altered_items(spark):
    rng = random.Random(31)
    items = {i: words(rng, rng.choice([12, 40, 60, 100]), 9000) for i in range(12)} | {90: "only three words", 91: "a b"}
    texts, expected = {}, {}
    for n in range(220):
        i = rng.randrange(12)
        x = items[i].split()
        for _ in range(rng.randrange(3)):
            x[rng.randrange(len(x))] = f"y{n}"
        if n % 5 == 0:
            x.insert(rng.randrange(len(x)), "more")
        texts[n] = " ".join([words(rng, rng.randrange(30), 9000), *x, words(rng, rng.randrange(30), 9000)])
    texts[500], texts[501] = "here ONLY three  words stand", "a b"
    for d, t in texts.items():
        for i, x in items.items():
            if (s := brute_similarity(t, x)) >= 0.8:
                expected[d, i] = round(s, 6)
    table = [*texts.items(), (None, items[0]), (0, texts[0]), (600, None), (601, "")]
    bench = spark.createDataFrame([*items.items(), (None, items[1]), (3, items[3]), (92, None), (93, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(docs(spark, table), bench.where("item_id IS NOT NULL")).collect()}
    near = [k for k, s in expected.items() if s < 0.9]
    assert len(expected) > 60 and len(near) > 15
    assert set(got) <= set(expected) and all(got[k] == expected[k] for k in got)
    assert len(got) >= 0.97 * len(expected) and sum(k in got for k in near) >= 0.9 * len(near)


def test_context_words_decide(spark):
    texts = {
        1: "my ssn is 123-45-6789", 2: "part 123-45-6789 in the list", 3: "Social Security no. 123-45-6789, card 4111 1111 1111 1111", 4: "4111111111111111",
        5: "call +49 30 1234567", 6: "+49 30 1234567", 7: " ".join(f"a{i}@b.org" for i in range(700)),
    }
    got = {r.doc_id: r for r in pii.digests(docs(spark, texts.items())).collect()}
    assert [got[i].spans.split(":")[0] for i in (1, 2)] == ["ssn", ""]
    assert got[3].scores == "0.6,1.0" and got[4].scores == "0.8" and (got[5].scores, got[6].scores) == ("0.8", "0.6")
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest()  # an added kind isn't in the base
    spans = ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"a\d+@b\.org", texts[7]))
    assert got[7].spans == spans and got[7].n_email == 700
    clean = {r.doc_id: r.text for r in pii.redact(docs(spark, texts.items())).collect()}
    assert clean[1] == "my ssn is [SSN]" and clean[2] == texts[2]


@pytest.mark.parametrize("width", [1, 12, 40])
def test_top_k_in_blocks(spark, monkeypatch, width):
    monkeypatch.setattr(topk, "CANDIDATES", 128)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(width)
    v = rng.normal(0, 0.3, (700, width))
    v[100:160] = v[100]  # ties
    v[200:230] = 0
    rows = [(int(i), x.tolist(), 1) for i, x in enumerate(v)] + [(40, v[40].tolist(), 1), (41, v[41].tolist(), 1), (None, v[0].tolist(), 1), (2000, [], 1), (2020, [float("inf")] * width, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, b int").withColumn("side", F.lit(9)).withColumn("x", F.lit("clash"))
    ids = np.array([r[0] for r in rows if r[0] is not None and r[0] != 2020])
    x = np.array([np.floor(np.array(r[1] if len(r[1]) else [0.0] * width) * 64) for r in rows if r[0] is not None and r[0] != 2020]).astype(int)
    got = {}
    for r in topk.top_k(table, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in ids if i % 20 == 0}
    for q, found in got.items():
        s = x @ x[list(ids).index(q)]
        best = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-s[j], ids[j]))[:20]
        assert sorted(found) == [(n + 1, ids[j], s[j]) for n, j in enumerate(best)]
    assert topk.top_k(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_later_letters_are_split_as_the_library_does():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_file())
    own = bpe.Bpe(tokenizer_file())
    later = [c for a, z in [*bpe.LATER_LETTERS, *bpe.LATER_NUMBERS] for c in (a, (a + z) // 2, z)] + list(bpe._later_lower)
    for c in later:
        text = f"a{chr(c)}B {chr(c)}{chr(c)}9"
        assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids, hex(c)


# ---------------------------------------------------------------- stages
def test_stages_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(41)
    item = words(rng, 30, 5000)
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    english = ["the cat sat on the mat", "a dog and the house", "the mat and a dog sat"]
    german = ["der hund und die katze", "die katze sitzt auf dem dach", "und der hund sitzt"]
    learn = [(100 + i, english[i % 3] if i % 2 else german[i % 3], ("de", "en")[i % 2]) for i in range(60)]
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in learn] + [(i, t, None, None, None) for i, t in [*odd, (8, item + " call +49 30 1234567")]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1))
    kept = p.language(spark, table, str(tmp_path))
    assert kept.columns == p.COLUMNS
    model = langid.fit(table)
    brute = sorted(str((i, t)) for i, t, *_ in rows if (got := model.predict(t))[0] != "und" and got[1] >= 0.5)
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == brute and len(brute) < len(rows)

    clean = p.personal_data(spark, table, str(tmp_path)).toPandas()
    spans = {r.text: r for r in pii.detect(table).join(table.select("doc_id", "text"), "doc_id").collect()}
    assert len(clean) == len(rows) and clean["text"].isna().sum() == 2
    assert set(clean["n_chars"].dropna()) <= {len(t) for t in clean["text"].dropna()}
    assert clean["text"].dropna().str.contains(r"\[PHONE\]").sum() == 1 and clean["text"].dropna().str.contains(r"\[EMAIL\]").sum() == 4 and spans

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_file())
    for r in p.tokens(spark, table.where("doc_id <> 5"), str(tmp_path)).collect():
        text = [t for i, t, *_ in rows if i == r.doc_id and (lib.encode(t or "", add_special_tokens=False).ids == list(r.ids))]
        assert text and r.n_tokens == len(r.ids)
    for stage in (f for _, f in p.STAGES):
        assert stage(spark, table.where("false"), str(tmp_path)).count() == 0


def brute_groups(rows):
    """Least row of each group of rows linked by a Jaccard similarity of 0.8 of their five-word shingles."""
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else None for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if x in (ra, rb) else x for x in root]
    return root, sets


def test_two_stages_in_a_row_equal_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(51)
    items = {i: words(rng, 40, 9000) for i in range(5)}
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = []
    for i in range(160):
        base = words(rng, rng.choice([7, 30, 120]), 9000).split() if i % 4 == 0 or not rows else rng.choice(rows)[1].split()
        for _ in range(rng.randrange(3)):
            base[rng.randrange(len(base))] = f"z{i}"
        rows.append((i, " ".join(base)))
    rows += [(200 + i, words(rng, 20, 9000) + " " + x + " " + words(rng, 5, 9000)) for i, x in items.items()]
    root, _ = brute_groups(rows)
    first = {}
    for k, r in enumerate(root):
        first[r] = min(first.get(r, rows[k][0]), rows[k][0])
    kept = {i for k, (i, _) in enumerate(rows) if first[root[k]] == i}
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    once = p.near_duplicates(spark, table, str(tmp_path)).cache()
    assert {r.doc_id for r in once.collect()} == kept
    clean = {i for i, t in rows if i in kept and max(brute_similarity(t, x) for x in items.values()) < 0.8}
    assert {r.doc_id for r in p.decontamination(spark, once, str(tmp_path)).collect()} == clean and len(clean) < len(kept)
