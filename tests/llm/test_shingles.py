"""Near copies by shingles against all pairs, and the pipeline's stage on edits beyond four bits."""

import random

import corpus_pipeline
from segrank.llm import shingles, simhash


def sets(t):
    w = (t or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}


def plain(texts):
    own = {i: sets(t) for i, t in texts.items()}
    root = {i: i for i in own}
    for a in own:
        for b in own:
            both = len(own[a] & own[b])
            if root[a] != root[b] and 5 * both >= 4 * (len(own[a] | own[b])):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return {i for i in own if root[i] == i}


def edited(r, text, n):
    w = text.split()
    for k in r.sample(range(len(w)), n):
        w[k] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def corpus():
    r = random.Random(11)
    prose = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    passage, base = prose(60), [prose(200) for _ in range(15)]
    texts = [None, "", "one two", "One  two", *base, *(edited(r, b, n) for b in base for n in (1, 2, 4, 4, 5, 8)), *(f"{prose(50)} {passage} {prose(50)}" for _ in range(30)), base[0].upper()]
    texts += [edited(r, base[3], 2) for _ in range(40)]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return dict(zip(ids, texts, strict=True))


def test_stage_reaches_a_similarity_of_four_fifths(spark):
    texts = corpus()
    fps = {i: simhash.fingerprint(t) for i, t in texts.items()}
    own = {i: sets(t) for i, t in texts.items()}
    assert any((fps[a] ^ fps[b]).bit_count() > 4 and 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]) for a in own for b in own)
    docs = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, "").collect()} == plain(texts)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_small_chunks_and_any_sample_give_the_same(spark, monkeypatch):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(shingles, "COUNTED", 0)
    monkeypatch.setattr(shingles._links, "__defaults__", (3,))
    assert {x["doc_id"] for x in shingles.drop_near_copies(docs).collect()} == plain(texts)


def test_rows_without_an_id_stay(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (2, "a b"), (None, "a b")], "doc_id long, text string")
    assert sorted(str(x["doc_id"]) for x in shingles.drop_near_copies(docs).collect()) == ["2", "None", "None"]


def test_sketches_lose_no_pair():
    r = random.Random(3)
    for n in (60, 300, 3000):
        base = " ".join(f"w{r.randrange(5000)}" for _ in range(n))
        own = [shingles.shingles(x) for x in (base, *(edited(r, base, k) for k in range(1, n // 20, 7)))]
        for a in own:
            for b in own:
                for wide in (shingles.WIDE, shingles.LONG):
                    differ = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(shingles.sketch(a, wide), shingles.sketch(b, wide), strict=True))
                    assert differ <= len(set(a.tolist()) ^ set(b.tolist()))
                assert shingles._maybe(shingles._long_sketch(a), shingles._long_sketch(b)) or not shingles.similar(a, b)
