"""N-gram join, hard negatives and alignment against brute force, and on odd inputs."""

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.llm import alignment, negatives, ngrams, toxicity
from flowsift.llm.registry import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, n long, row long, keys string, root long, band int, groups string"
A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def docs(spark, rows):
    """Rows (doc_id, text) with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, "k", 4, 5, "g") for i, t in rows], DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# ---------------------------------------------------------------- n-gram join
def joined(rows, size=4, least=Fraction(85, 100)):
    """Brute force over all pairs of rows."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets.append(({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or {tuple(w)}) if w else set())
    comp = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and len(sets[x] & sets[y]) >= least * len(sets[x] | sets[y]):
                old, new = comp[x], comp[y]
                comp = [new if c == old else c for c in comp]
    out = []
    for (i, _), s, c in zip(rows, sets, comp):
        ids = [j for (j, _), d in zip(rows, comp) if d == c and j is not None]
        out.append((i, len(s), min(ids, default=None)))
    return sorted(out, key=repr)


def copies(rng, groups=12):
    rows = []
    for _ in range(groups):
        own = words(rng, rng.choice([3, 8, 30, 90, 200])).split()
        for _ in range(rng.randrange(1, 7)):
            w = list(own)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            w = w[: len(w) - rng.randrange(0, 1 + len(w) // 12)]
            rows.append(" ".join(w).title() if rng.random() < 0.2 else "\t ".join(w))
    line = " ".join(f"licence{i}" for i in range(25))
    rows += [f"{line} {words(rng, 3)}" for _ in range(8)] + [None, "", " \n", "One two", "one  TWO", "é É", "É É"]
    return rows


@pytest.mark.parametrize("few, part, volume", [(8, 2048, 500_000), (1, 2, 60)])
def test_groups_of_similar_sets(spark, monkeypatch, few, part, volume):
    monkeypatch.setattr(ngrams, "FEW", few), monkeypatch.setattr(ngrams, "PART", part), monkeypatch.setattr(ngrams, "VOLUME", volume)
    rng = random.Random(few)
    texts = copies(rng)
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[5]), (None, "nobody has this text but one"), (4, texts[9])]
    got = ngrams.similarity_join(docs(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == joined(rows)


def test_ngram_join_of_long_and_no_texts(spark):
    long = words(random.Random(3), 60_000, 3000)
    rows = [(2, long), (1, long + " and one more"), (3, long[: len(long) // 2])]
    got = {r.doc_id: r.component_id for r in ngrams.similarity_join(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    empty = ngrams.similarity_join(docs(spark, []))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_shingles", "component_id"]
    assert len(ngrams.similarity_join(docs(spark, [(1, None), (None, "")])).collect()) == 2


def test_similar_sizes_are_in_neighbouring_bands(spark):
    n = spark.range(1, 3000).select(F.col("id").alias("n")).withColumn("band", ngrams.band(F.col("n"), 17, 20)).toPandas()
    band = dict(zip(n["n"], n["band"]))
    assert all(band[m] - band[-(-m * 17 // 20)] in (0, 1) for m in range(1, 3000))


def test_tiles_hold_every_pair_of_near_bands(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.randrange(4), i) for i in range(60)]
    got = ngrams.tiles(spark.createDataFrame(rows, "key long, band int, node long"), "key", F.lit(1), 4).collect()
    held = defaultdict(set)
    for r in got:
        held[r.key, r.lo, r.hi, r.i, r.j].add(r.node)
    met = {(x, y) for nodes in held.values() for x in nodes for y in nodes if x < y}
    assert met >= {(x, y) for k, b, x in rows for m, c, y in rows if x < y and k == m and abs(b - c) <= 1}
    assert max(map(len, held.values())) < 30 and all(k == rows[n][0] for (k, *_), nodes in held.items() for n in nodes)


# ---------------------------------------------------------------- hard negatives
VECTORS = "vec_id long, embedding array<float>, label int, anchor long, part int, x string, score long, nth int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, 2, "x", 3, 4) for i, v, y in rows], VECTORS)


def mined(rows, every, positives=5, k=10):
    inf = float("inf")
    rows = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(c is not None and abs(c) < inf for c in v)]
    out = []
    for i, v, y in {(i, tuple(v), y) for i, v, y in rows if i % every == 0}:
        dot = lambda w: sum(a * b for a, b in zip(v, w))  # noqa: E731, B023
        alike = sorted((-dot(w), j) for j, w, z in rows if j != i and z == y)[:positives]
        for minus, j in alike:
            fits = sorted((-dot(w), n) for n, w, z in rows if n != i and z != y and 30 * -minus <= 100 * dot(w) <= 90 * -minus)[:k]
            out += [(i, j, r + 1, n, -minus, -s) for r, (s, n) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("block, scores", [(32_768, 4_000_000), (7, 20)])
def test_negatives_of_overlapping_windows(spark, monkeypatch, block, scores):
    monkeypatch.setattr(negatives, "BLOCK", block), monkeypatch.setattr(negatives, "SCORES", scores)
    rng = np.random.default_rng(block)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(0.2, 0.5, 6).round(1)], int(rng.choice([0, 0, 0, 1, 2, 3]))) for i in range(120)]
    rows += [(200 + i, rows[0][1], i % 2) for i in range(30)]  # one vector many times: ties
    rows += [(None, rows[1][1], 1), (240, None, 1), (242, [0.1, None], 1), (244, [float("nan")] * 6, 0), (246, [float("inf")] * 6, 0), (248, [0.5, 0.25], 1), (250, [], 0), (251, rows[2][1], None)]
    rows += [rows[5], rows[10], (10, rows[11][1], 3), (300, rows[10][1], 7)]  # repeated rows, an id with two vectors, a label of its own
    got = negatives.mine(vectors(spark, rows), F.col("vec_id") % 5 == 0, F.col("label"))
    assert sorted(map(tuple, got.collect())) == mined(rows, 5)


def test_negatives_beyond_floats_and_of_nothing(spark):
    rows = [(i, [float(2**20 * (1 + i / 8))] * 40, i % 2) for i in range(40)]
    got = negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"), window=(30, 99))
    assert got.count() > 0 and all(100 * r.negative_score <= 99 * r.positive_score for r in got.collect())
    for few in ([], rows[:1], [(10, None, 1)]):
        got = negatives.mine(vectors(spark, few), F.col("vec_id") % 10 == 0, F.col("label"))
        assert got.collect() == [] and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


# ---------------------------------------------------------------- alignment
def aligned(rows):
    """Both libraries and loops over bytes."""
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = {c: n for n, c in enumerate(alignment.byte_symbols())}
    a_bytes = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, counts = [], Counter()
    for i, t in rows:
        one, two = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        whole = (" " + (t or "")).encode()
        if not t or b"".join(map(a_bytes, one)) != whole or b"".join(map(b_bytes, two)) != whole:
            out.append((i, [], [], [], []))
            continue
        ends = []
        for ids, of in ((one, a_bytes), (two, b_bytes)):
            n, e = 0, {}
            for at, token in enumerate(ids):
                n += len(of(token))
                e[n] = at
            ends.append(e)
        cuts = sorted(ends[0].keys() & ends[1].keys())
        pairs = [(one[ends[0][c]], two[ends[1][c]]) for c in cuts]
        counts.update(pairs)
        groups, x, y = [], 0, 0
        for c in cuts:
            groups.append((one[x : ends[0][c] + 1], two[y : ends[1][c] + 1]))
            x, y = ends[0][c] + 1, ends[1][c] + 1
        out.append((i, one, two, groups, pairs))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    done = []
    for i, one, two, groups, pairs in out:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        done.append((i, len(one), len(two), len(groups), len(pairs), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if groups else "", text))
    return sorted(done, key=repr)


ODD = ["", None, " ", "\n\n  \t", "a", "▁a", "x" * 70, "naïve café — “quoted”", "数学 и язык", "🙂🙃", "<|endoftext|> and </s> <s> <unk> <0x41>", "é​﻿", "\x00\x01", "don't  stop   12345", "a" * 300 + " " + "ab" * 200]


@pytest.mark.parametrize("size, told", [(1 << 16, 2_000_000), (5, 2_000_000), (64, 0)])
def test_aligned_groups_and_links(spark, monkeypatch, size, told):
    monkeypatch.setattr(alignment, "TOGETHER", 2)
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, words(rng, 40, 30).replace("w", rng.choice("w ñ"))) for i in range(20)]
    rows += [rows[4], rows[-1], (None, "no id"), (4, "another text")]
    got = alignment.align(docs(spark, rows), A, B, size, keep=True, told=told)
    assert sorted(map(tuple, got.collect()), key=repr) == aligned(rows)


def test_alignment_of_whole_tables_and_of_none(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = aligned([tuple(r) for r in table.select("doc_id", "text").collect()])
    got = alignment.align(table, A, B, size=4096)
    assert sorted(map(tuple, got.collect()), key=repr) == [r[:-1] for r in want]
    empty = alignment.align(docs(spark, []), A, B)
    assert empty.collect() == [] and empty.columns == got.columns


def test_composition_is_associative(spark):
    rng = random.Random(2)

    def fragment():
        ids = lambda n: ",".join(str(rng.randrange(9)) for _ in range(rng.randrange(n)))
        return (True, ids(3) or "1", ids(3) or "2", rng.choice(["", "1|2", "3,4|5;6|7"]), ids(3), ids(3)) if rng.random() < 0.6 else (False, ids(3), ids(3), "", "", "")

    kind = "struct<cut:boolean,pre_a:string,pre_b:string,closed:string,suf_a:string,suf_b:string>"
    rows = spark.createDataFrame([tuple(fragment() for _ in range(3)) for _ in range(300)], f"x {kind}, y {kind}, z {kind}")
    c, none = alignment.compose, F.lit(None).cast(kind)
    x, y, z = (F.col(n) for n in "xyz")
    assert rows.where(c(c(x, y), z) != c(x, c(y, z))).count() == 0
    none = F.struct(F.lit(False).alias("cut"), *[F.lit("").alias(n) for n in alignment.FRAGMENT[1:]])
    assert rows.where((c(x, none) != x) | (c(none, x) != x)).count() == 0


def test_a_vocabulary_that_does_not_follow_its_merges(tmp_path):
    import json

    spec = json.load(open(A, encoding="utf-8"))
    merges = spec["model"]["merges"]
    merges[0], merges[1] = merges[1], merges[0]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    own = alignment.Aligner(str(path), B)
    assert own.tokens("some text, that is there")[0][0].tolist() and own.a.encode.__qualname__.startswith("ByteLevel")


# ---------------------------------------------------------------- subsequence kernel
def gapped(a, b):
    """All common subsequences of three characters within SPAN, each weighed by its gaps in either word."""
    import itertools

    def of(w):
        out = defaultdict(float)
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < toxicity.SPAN:
                out[toxicity._codes([w], len(w))[0][[i, j, k]].tobytes()] += toxicity.DECAY ** (k - i - 2)
        return out

    # a subsequence that occurs twice in a word counts by each occurrence
    norm = lambda w: sum(toxicity.DECAY ** (2 * (k - i - 2)) for i, j, k in itertools.combinations(range(len(w)), 3) if k - i < toxicity.SPAN) ** 0.5
    x, y = of(a), of(b)
    value = (sum(v * y[c] for c, v in x.items()) / (norm(a) * norm(b))) ** toxicity.POWER if len(a) > 2 and len(b) > 2 else 0.0
    return value if value >= toxicity.LEAST else 0.0


def test_kernel_against_all_subsequences():
    rng = random.Random(4)
    words_ = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 13))) for _ in range(60)] + ["idiot", "idxiot", "i", "ab"]
    marks = ["idiot", "stupid", "abcabc", "deé"]
    got = toxicity.Kernel(marks)(words_)
    assert np.allclose(got, [[gapped(w, m) for m in marks] for w in words_], atol=1e-4)


def test_values_of_a_word_are_those_of_its_best_piece():
    model = toxicity.Model(["idiot", "stupid"], np.ones(2), 0.0, (1.0, 0.0, 0.0))
    kernel = toxicity.Kernel(["idiot", "stupid"])
    for w in ("idiotically", "(idiot!)", "i-d-i-o-t", "stupidity", "house"):
        assert np.allclose(model.pooled([[w]])[0], np.max([kernel([p])[0] for p in toxicity.pieces(w)], axis=0))
    texts = ["you idiot. and you stupid one. nothing here at all. idiots all", "", None, "fine"]
    naive = []
    for t in texts:
        values = sorted([max(0.0, float(model.pooled([g])[0].sum())) for g in toxicity.sentences(t)] + [0.0] * 3)[-3:]
        naive.append((values[-1], sum(values)))
    assert np.allclose(model.evidence(texts), naive, atol=1e-5)


def test_greatest_values_by_owner():
    rng = np.random.default_rng(8)
    top, owner, value = np.zeros((5, 3)), rng.integers(0, 5, 200), rng.normal(size=200)
    for part in np.split(np.arange(200), 7 * np.arange(1, 20)):
        toxicity.raise_top(top, owner[part], value[part])
    assert np.allclose(top, [np.sort(np.maximum(value[owner == o], 0))[-3:] for o in range(5)])
