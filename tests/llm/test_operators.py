"""Every operator on small fixtures with nulls, empty texts, ties, repeats, extra columns and empty tables, against plain versions."""

import base64
import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash

from segrank.llm import bpe, decontaminate, extract, pii, quality, simhash, substring, tokencount, urls, warc

public = pytest.importorskip("public_tokenizers")
BPE = public.path("byte_bpe_50k.json")
EMPTY = "doc_id long, text string, lang string, fp string, n_words int"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)], EMPTY)


def prose(r, n):
    return " ".join(r.choice(["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(r.randrange(30)) for _ in range(n))


def test_simhash_against_all_pairs(spark):
    r = random.Random(5)
    base = [prose(r, 200) for _ in range(12)]
    texts = [None, "", "  \n", "one", *base, *base[:3], *(b + " tail words" for b in base), *(b.replace("alpha", "ALPHA") for b in base)]
    docs = frame(spark, texts)
    fps = {i: simhash.fingerprint(t) for i, t in enumerate(texts)}
    root = {i: i for i in fps}
    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    for how in ({}, {"agree": 2, "chunk": 2}, {"agree": 3}):
        got = {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in simhash.near_duplicates(docs, **how).collect()}
        assert got == {i: (f"{fps[i]:016x}", root[i]) for i in fps}
    assert fps[0] == fps[1] == fps[2] == 0 and fps[3] == xxhash.xxh64_intdigest(b"one", 42)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(x[0] for x in simhash.drop_near_duplicates(docs).select("doc_id").collect()) == sorted(set(root.values()))


def test_simhash_null_ids_and_repeats(spark):
    got = simhash.near_duplicates(frame(spark, ["a b", "a b", "a b"], [None, 7, 7])).collect()
    assert len(got) == 3 and {x["component_id"] for x in got} == {7}


def test_stars_reach_the_smallest_node(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(simhash.components(chain).collect())
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_url_rules(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.COM/en/x?y"), (4, "http://com/"), (5, "a://b.net/es/://c"), (6, "http://xexample.com/en/"), (7, "http://example.com?x"), (7, "http://example.com?x"), (None, "http://a.example.com/en/#f")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, rule string, html string")
    got = [tuple(x) for x in urls.judge_urls(pages, urls.listed(spark)).orderBy("page_id").collect()]
    assert got == [
        (None, "a.example.com", "/en/", "example.com/en/", "block"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (4, "com", "/", "com/", "allow"),
        (5, "b.net", "/es/://c", "net/es/", "block"), (6, "xexample.com", "/en/", "com/", "allow"), (7, "example.com", "", None, "allow"), (7, "example.com", "", None, "allow"),
    ]
    assert {x["verdict"] for x in urls.judge_urls(pages, urls.listed(spark).limit(0)).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), urls.listed(spark)).count() == 0


def test_url_rules_by_lookup_and_by_join(spark, monkeypatch):
    r = random.Random(14)
    part = lambda: r.choice("ab")
    rules = sorted({".".join(part() for _ in range(r.randrange(1, 4))) + "/" + "".join(part() for _ in range(r.randrange(0, 3))) for _ in range(40)})
    listed = urls.listed(spark, [(x, r.choice(["allow", "block"])) for x in rules])
    pages = spark.createDataFrame([(i, "http://" + ".".join(part() for _ in range(r.randrange(1, 5))) + "/" + "".join(part() for _ in range(r.randrange(0, 4)))) for i in range(300)], "page_id long, url string")
    df = urls.judge_urls(pages, listed)
    assert "Exchange hashpartitioning" not in df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString() and "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    looked = sorted(map(tuple, df.collect()))
    monkeypatch.setattr(urls, "small_enough", lambda *a: False)
    assert sorted(map(tuple, urls.judge_urls(pages, listed).collect())) == looked
    verdicts = {x["rule"]: x["verdict"] for x in listed.collect()}
    for i, host, path, rule, verdict in looked:
        fits = [x for x in rules if (host == (h := x.split("/")[0]) or host.endswith("." + h)) and path.startswith(x[len(h) :])]
        assert rule == (max(fits, key=lambda x: (len(x), x.index("/"), x)) if fits else None) and verdict == verdicts.get(rule, "allow")
    with pytest.raises(ValueError):
        urls.judge_urls(pages, urls.listed(spark, [("com", "block")]))


def test_hot_keys_are_spread(spark, monkeypatch):
    from segrank.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    big = spark.range(500).selectExpr("id", "if(id % 3 = 0, 7, id) AS k")
    small = big.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 2 AS v")
    got = common.spread_join(big, small, ["k"], "id")
    assert sorted(map(tuple, got.select("id", "v").collect())) == [(i, 14 if i % 3 == 0 else 2 * i) for i in range(500)] and got.columns == ["k", "id", "v"]


def test_pivots_discard_most_pairs():
    """Of random fingerprints that share a block of 12 bits, coordinates leave few of the pairs that are beyond four bits."""

    fps = np.random.default_rng(3).integers(0, 2**52, 600, dtype=np.uint64)
    table = np.array([[int(f ^ np.uint64(p & (2**64 - 1))).bit_count() for p in simhash.references()] for f in fps], dtype=np.int16)
    i, j = np.triu_indices(len(fps), 1)
    left = (np.abs(table[i] - table[j]).max(axis=1) <= simhash.MAX_BITS).sum()
    assert left / len(i) < 0.02, left / len(i)


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(BPE)
    e = bpe.Encoder(BPE, window=16)
    r = random.Random(2)
    texts = ["", "a\n\n b", "<|endoftext|>x<|endoft", "don't we'll  's", "é😀 中文\t \n x", "z" * 3000]
    texts += ["".join(r.choice(a) for _ in range(r.choice([5, 200, 900]))) for a in ("ab", "thein \n'", "=-_*", "0 1\t2", "aeiou ", "éaßü中 ") for _ in range(25)]
    old, bpe.CHUNK = bpe.CHUNK, 64
    try:
        for s in texts:
            ids = t.encode(s, add_special_tokens=False).ids
            assert e.encode(s) == ids and e.decode(ids) == t.decode(ids, skip_special_tokens=False)
    finally:
        bpe.CHUNK = old
    word = "".join(r.choice("thequickbrown") for _ in range(5000)).encode()
    assert list(e.transduce(word[i : i + 7] for i in range(0, len(word), 7))) == t.encode(word.decode(), add_special_tokens=False).ids
    broken = [e.first[0xE4], e.first[0xB8], 11]
    assert e.decode(broken) == t.decode(broken, skip_special_tokens=False)
    got = {x["doc_id"]: x for x in bpe.token_digests(frame(spark, [None, "hello world", "hello world"]), BPE).collect()}
    assert got[0]["n_tokens"] == 0 and got[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest() and got[1]["ids_sha256"] == got[2]["ids_sha256"]
    docs = frame(spark, [None, "", "round trip é"])
    back = {x[0]: x[1] for x in bpe.decode_documents(bpe.encode_documents(docs, BPE), BPE).collect()}
    assert back == {0: "", 1: "", 2: "round trip é"} and bpe.token_digests(docs.limit(0), BPE).count() == 0


def test_bpe_holds_long_pre_tokens_in_parts():
    tokenizers = pytest.importorskip("tokenizers")
    t, e, r = tokenizers.Tokenizer.from_file(BPE), bpe.Encoder(BPE), random.Random(3)
    for s in ("a" * 150_000 + "'s", " " * 140_000 + "x", "-=" * 80_000, "".join(r.choices("thequickbrown", k=150_000)), "x\t" * 40_000 + "y" * 80_000, "".join(r.choices("ab12", k=90_000))):
        assert e.encode(s) == t.encode(s, add_special_tokens=False).ids
    peaks = []
    for n in (150_000, 600_000):  # one run of letters: what is held doesn't grow with it
        s = "".join(r.choices("thequickbrown", k=n))
        tracemalloc.start()
        e.digest(s)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0]


def plain_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_pii_base_spans_and_redaction(spark):
    r = random.Random(3)
    texts = [None, "", "9" * 20000 + " " + "1 " * 9000, "a" * 50000 + "@", "x@y" + ".z" * 3000, "4111 1111 1111 1111 +1 (555) 123-4567 a@b.co 1.2.3.4 1.2.3.256"]
    texts += ["".join(r.choice(a) for _ in range(60)) for a in ("0123456789 -", "a@.b_c", "+1(2)3 .-4", "012.3", "é😀@a.b", "\x01\x02a@b.c1.2.3.4") for _ in range(60)]
    got = {x["doc_id"]: x for x in pii.personal_data(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = plain_pii(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
    assert got[5]["n_card"] == got[5]["n_phone"] == got[5]["n_email"] == got[5]["n_ip"] == 1
    docs = spark.createDataFrame([(1, "mail a@b.co or call (555) 123-4567 now"), (2, None), (3, "rows 12 345 678 in all")], "doc_id long, text string")
    assert [x["text"] for x in pii.redact(docs).orderBy("doc_id").collect()] == ["mail <email> or call <phone> now", None, "rows 12 345 678 in all"]
    assert pii.personal_data(docs.limit(0)).count() == 0


#: Sentences, words and names that neither fitted nor calibrated the trees.
TO_TEST = {
    "cue": {"email": ("mailto ", "contact him: ", "reach her "), "ip": ("the ip is ", "hosts: ", "my server "), "card": ("a debit ", "master ", "his payment: "), "phone": ("telephone ", "dial ", "ring: ", "cellular ")},
    "bare": ("", "later on, ", "(she said) ", "and "), "tail": ("", " here", " again.", "? yes", " tonight"),
    "contra": {"ip": ("rev ", "chapters ", "sections "), "card": ("batch ", "refs ", "sku "), "phone": ("parts ", "orders ", "totals ", "models ")},
    "name": ("zoe", "t.smith", "desk", "hans-m"), "site": ("uni", "post-office", "trade"), "tld": ("uk", "gov", "io"), "verb": ("we stay", "nobody is", "it stopped, not", "here"), "place": ("midnight", "church", "four", "sea"), "end": ("otherwise", "but", "so", "as"),
}


def plain_spans(t):
    """All spans by the method's definition: base spans, then proposals apart from them that the trees select, first come first."""
    model = pii.train()
    base = sorted((int(a), pii.KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in plain_pii(t).split(",") if x))
    out, at = [], 0
    for a, b, k in sorted(p for p in pii.proposals(t) if not any(x < p[1] and p[0] < y for x, _, y in base)):
        if a >= at and sum(pii._weight(tree, pii.plain_features(t, a, b, k)) for tree in model[k][0]) >= model[k][1]:
            out.append((a, k, b))
            at = b
    # columns are sorted by (start, end, kind)
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in sorted((a, b, k) for a, k, b in base + out))


def plain_redact(t):
    out, at = [], 0
    for k, a, b in ((k, int(a), int(b)) for k, a, b in (x.split(":") for x in plain_spans(t).split(",") if x)):
        if a >= at:
            out += [t[at:a], f"<{k}>"]
        at = max(at, b)
    return "".join([*out, t[at:]])


def test_pii_spans_against_brute_force(spark):
    r = random.Random(12)
    made = [t for t, _, _ in pii.examples(TO_TEST, 60, 4)]
    texts = [None, "", *made, *(" ".join(r.choice([*made, "é😀 a@b.co", "+1 (555) 123-4567", "1.2.3.4", "4111 1111 1111 1111", "x" * r.randrange(900)]) for _ in range(40)) for _ in range(20))]
    texts.append(" ".join(f"call 555-123-{i:04d} or a{i}@b.co" for i in range(1500)))  # many spans: lists longer than FULL, text longer than BLOCK
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, _t string, n_ip int")  # clashing names
    got = {x["doc_id"]: x["spans"] for x in pii.personal_data(docs).collect()}
    assert got == {i: plain_spans(t or "") for i, t in enumerate(texts)} and got[len(texts) - 1].count("phone") == 1500
    assert sum(s != plain_pii(t or "") for s, t in zip(got.values(), texts)) > 50  # the trees add spans
    red = pii.redact(docs)
    assert red.columns == docs.columns and {x["doc_id"]: x["text"] for x in red.collect()} == {i: None if t is None else plain_redact(t) for i, t in enumerate(texts)}
    assert pii.redact(docs.limit(0)).count() == 0


def test_pii_model_on_other_examples():
    model = pii.train()
    for k, kind in enumerate(pii.KINDS):
        x, y = pii.measured(pii.examples(TO_TEST, 400, 99), k)
        taken = [sum(pii._weight(t, row) for t in model[k][0]) >= model[k][1] for row in x]
        assert sum(a and b for a, b in zip(taken, y)) >= 0.9 * sum(y), kind
        assert sum(a and not b for a, b in zip(taken, y)) <= 0.02 * sum(taken), kind


@pytest.mark.parametrize(("text", "spans"), [
    ("host 300 . 400 . 500 . 600", ""), ("see 999 . 999 . 999 . 999", ""), ("section 10. 20. 30. 40", ""), ("we meet (at) noon.sharp", ""), ("phone model 100.200.3000", ""), ("look at example.com", ""), ("rows 5551234567 in all", ""),
    ("card 4111/1111/1111/1112", ""), ("serial 4111/1111/1111/1111", ""), ("ann at example dot com", "email:0:22"), ("call me on 5551234567", "phone:11:21"), ("ip 10 . 0 . 0 . 1", "ip:3:17"), ("card 4111/1111/1111/1111", "card:5:24"), ("(555) 123-4567", "phone:0:14"),
])
def test_pii_verdicts(text, spans):
    assert plain_spans(text) == spans


def plain_repeats(docs, window=13):
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    first = {}
    for i in sorted(split):
        for k in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][k : k + window]), i)
    out = {}
    for i, w in split.items():
        cut = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        kept = [x for k, x in enumerate(w) if k not in cut]
        out[i] = (len(w), len(cut), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_substring_dedup(spark):
    r = random.Random(4)
    passage = prose(r, 30)
    texts = [None, "", "short text", *(prose(r, r.randrange(5, 80)) + " " + passage * (k % 3) + " " + prose(r, 20) for k in range(40))]
    texts += [texts[5], texts[6], "a " * 40, "a " * 60, passage]
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring.remove_repeats(frame(spark, texts, ids).repartition(5)).collect()}
    assert got == plain_repeats(list(zip(ids, texts, strict=True)))
    assert substring.remove_repeats(frame(spark, texts).limit(0)).count() == 0
    assert {x["n_removed"] for x in substring.remove_repeats(frame(spark, [passage, passage], [None, 3])).collect()} == {0}


def test_fm_index_counts():
    r = random.Random(6)
    runs = [(d, [r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(4, 40))]) for d in range(12)]
    want = []
    for d, w in runs:
        want.append([k for k in range(len(w) - 3) if any(o < d and tuple(w[k : k + 4]) in zip(x, x[1:], x[2:], x[3:]) for o, x in runs)])
    assert [x.tolist() for x in substring.repeats(runs, 4)] == want
    sub = substring.repeats(runs[:6] + runs, 4, list(range(6)))[6:]
    assert [x.tolist() for x in sub] == [[k for k in range(len(w) - 3) if any(o < d and tuple(w[k : k + 4]) in zip(x, x[1:], x[2:], x[3:]) for o, x in runs[:6])] for d, w in runs]


def test_matching_statistics_against_plain_search():
    r = random.Random(7)
    text, stream = (np.array([r.randrange(1, 4) for _ in range(n)]) for n in (60, 200))
    text[25] = 0
    text[-1] = 0
    ends = np.arange(9, 200)
    for least in (0, 1):
        places = lambda e, n: sum((text[k : k + n] == stream[e - n + 1 : e + 1]).all() for k in range(60 - n + 1))
        want = [max([n for n in range(1, 7) if places(e, n) > least], default=0) for e in ends]
        got, low, high = substring.matching_statistics(substring.FMIndex(text, 4, 6), stream, ends, 6, least)
        assert got.tolist() == want and (high - low).tolist() == [places(e, 6) for e, n in zip(ends, want, strict=True) if n == 6]
        assert len(set(want)) > 2


def test_warc_roundtrip(spark):
    rows = [(1, "u", "<a>"), (2, None, "<a>"), (3, "x\r\ny", "é"), (None, "u", "<a>"), (4, "q", None), (5, "q", ""), (1, "u", "<a>"), (None, "z", "only")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(map(tuple, warc.roundtrip(pages).collect()), key=repr)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"<a>": 1, "": 4}
    want = []
    for page, _, html in rows:
        f = first.get(html or "")
        again = f is not None and page != f
        want.append((page, len((html or "").encode()), sha(html), "revisit" if again else "response", f if again else None))
    assert got == sorted(want, key=repr)
    assert {x["record_type"] for x in warc.roundtrip(pages, min_bytes=4).collect()} == {"response"}
    assert warc.roundtrip(pages.limit(0)).count() == 0
    index = warc.write_archives(pages, warc.new_path(spark, "some"))
    some = warc.read_records(index.where("url = 'z'"), with_payload=True).collect()
    assert [bytes(x["payload"]) for x in some] == [b"only"]


def test_ranges_coalesce():
    places = [("a", 0, 10), ("a", 10, 5), ("a", 100, 5), ("b", 0, 5)]
    assert [(f, o, n, len(r)) for f, o, n, r in warc.ranges(iter(places), gap=8)] == [("a", 0, 15, 2), ("a", 100, 5, 1), ("b", 0, 5, 1)]


def plain_contamination(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if g := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= g
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark):
    r = random.Random(7)
    items = [(0, prose(r, 25)), (1, "Two words"), (2, None), (3, ""), (10, prose(r, 12)), (11, "x y z"), (0, "again one")]
    texts = [None, "", items[0][1].upper(), "see two-words, here", prose(r, 40) + " " + items[4][1] + " x_y z " + prose(r, 5), prose(r, 50), "ñandú TWO words TWO words"]
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, gram string")
    got = {x["doc_id"]: tuple(x)[1:] for x in decontaminate.contamination(frame(spark, texts), bench).collect()}
    assert got == plain_contamination(list(enumerate(texts)), items)
    assert not any(x["contaminated"] for x in decontaminate.contamination(frame(spark, texts), bench.limit(0)).collect())
    assert decontaminate.contamination(frame(spark, texts).limit(0), bench).count() == 0
    kept = {x["doc_id"] for x in decontaminate.drop_contaminated(frame(spark, texts), bench).collect()}
    assert kept == {i for i, v in got.items() if not v[4]}
    assert {x["doc_id"]: x["text"] for x in decontaminate.remove_spans(frame(spark, texts), bench).collect()}[3] == "see here"
    twice = spark.createDataFrame([(5, "see two-words, here", "x"), (5, "a b c", "y"), (None, "two words too", "z")], "doc_id long, text string, _cut string")
    assert sorted(tuple(x)[1:] for x in decontaminate.remove_spans(twice, bench).collect()) == [("a b c", "y"), ("see here", "x"), ("too", "z")]
    decontaminate_joined = pytest.MonkeyPatch()
    decontaminate_joined.setattr(decontaminate, "small_enough", lambda *a: False)  # a list too large to broadcast
    assert {x["doc_id"]: tuple(x)[1:] for x in decontaminate.contamination(frame(spark, texts), bench).collect()} == got
    decontaminate_joined.undo()


def test_token_counts(spark):
    path = public.path("piece_bpe_32k.model")
    scores, byte = tokencount.unigram_scores(path)

    def plain(w):
        x, best = tokencount.MARK + w, [(0.0, 0)]
        for i in range(1, len(x) + 1):
            n = len(x[i - 1].encode())
            options = [(best[i - 1][0] + byte * n, best[i - 1][1] - n)]
            options += [(best[j][0] + scores[x[j:i]], best[j][1] - 1) for j in range(i) if x[j:i] in scores]
            best.append(max(options))
        return -best[-1][1]

    texts = [None, "", "hello there unbelievable", "日本語 é😀 x" * 3, "hello hello"]
    got = {x["doc_id"]: (x["n_pretokens"], x["n_tokens"]) for x in tokencount.token_counts(frame(spark, texts), path).collect()}
    assert got == {i: (len((t or "").split()), sum(map(plain, (t or "").split()))) for i, t in enumerate(texts)}
    trie = tokencount.Trie(scores, byte, limit=50)
    assert [trie.insert(w) for w in ("there", "then", "theory", "the" * 2000)] == [plain(w) for w in ("there", "then", "theory", "the" * 2000)]


def test_extraction(spark):
    page = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href=x>Menu, item</a></nav><div class="ad">Buy, now</div>
    <article><h1>Head &amp; line</h1><p>One, two,   three <b>bo</b>ld.<br><p>Second&#32;para, with words.</p><form>no</form><aside>side</aside></article>
    <div id=comments><p>Nice, post, indeed, yes.</p></div><footer>&copy; foot</footer>"""
    assert extract.main_text(page) == "Head & line One, two, three bold. Second para, with words."
    assert extract.main_text("<div><p>Main text, long enough to count.</p><p>And more, of it.</p></div><div class=sidebar><p>a, b, c, d</p></div>") == "Main text, long enough to count. And more, of it."
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<nav>x</nav><!-- y") == ""
    assert extract.main_text("<div>" * 100000 + "deep") == "deep"
    pages = spark.createDataFrame([(1, "u", page, "z"), (None, None, None, "z"), (1, "u", page, "z")], "page_id long, url string, html string, text string")
    got = extract.extract_pages(pages).collect()
    assert len(got) == 3 and all(x["n_chars"] == len(x["text"]) for x in got) and extract.extract_pages(pages.limit(0)).count() == 0


HOSTILE = ("notice article-body", "search", "promo", "related-story", "widget", "post has-sidebar", "menu")


def made_page(r):
    """A page with a known article: furniture around and inside it, comments of readers behind it, names that mislead."""
    sentence = lambda: f"{prose(r, r.randrange(8, 20))}, {prose(r, r.randrange(3, 9))}."
    para = lambda: " ".join(sentence() for _ in range(r.randrange(2, 5)))
    links = lambda n: "".join(f'<li><a href="/{i}">{prose(r, 2)}</a></li>' for i in range(n))
    body, want = [], [prose(r, 6)]
    body.append(f"<h1>{want[0]}</h1>")
    for _ in range(r.randrange(4, 12)):
        t = para()
        want.append(t)
        body.append(r.choice([f"<p>{t}</p>", f"<p>{t}", f"<div><p>{t.replace(', ', ',&#32;', 1)}</p></div>", f"<p>\n {t.replace(' ', '  ', 3)}</p>"]))
        if r.random() < 0.3:
            body.append(r.choice([f'<div class="ad">{sentence()}</div>', f"<aside>{para()}</aside>", '<form action="/"><p>Your mail, please.</p><input name=m></form>', f'<ul class="share">{links(3)}</ul>', "<script>var a = '<p>x, y, z</p>';</script>", f'<p style="display: none">{para()}</p>', f'<div class="cookie-notice">{sentence()}</div>', "<!-- <p>gone, too</p> -->"]))
    if r.random() < 0.4:  # every paragraph inside further boxes
        body = [body[0], *(x if x.startswith(("<p>", "<div><p>")) is False or "</p>" not in x else f"<div><div>{x}</div></div>" for x in body[1:])]
    name = r.choice(HOSTILE)
    article = r.choice([f"<article>{''.join(body)}</article>", f'<div class="{name}">{"".join(body)}</div>', f'<div id="{name.split()[0]}">{"".join(body)}</div>', f"<main>{''.join(body)}</main>"])
    comments = "".join(f'<li class="comment"><p>{sentence()}</p></li>' for _ in range(r.randrange(0, 40)))
    page = f"""<html><head><title>{prose(r, 3)}</title><style>p{{}}</style></head><body class="has-sidebar no-comments"><nav><ul>{links(8)}</ul></nav><div class="breadcrumbs">{links(3)}</div>
    <header>{sentence()}</header>{article}<div id="comments"><ol>{comments}</ol></div><div class="sidebar"><p>{para()}</p></div><footer>{sentence()}</footer></body></html>"""
    return page, " ".join(want)


def plain_main_text(nodes):
    """The same scores from their definition, for a tree of extract.parse(): recursive, each node's points from all blocks below it."""
    found = [(box, " ".join(t.split()), links) for box, t, links in extract.blocks(nodes[0]) if t.split()]
    up = lambda n: [] if n is None else [n, *up(n.parent)]
    points = [extract.points_of(t, k) * math.prod(extract_factor(n) for n in up(box)) for box, t, k in found]
    inside = {id(n): [i for i, (box, _, _) in enumerate(found) if any(m is n for m in up(box))] for n in nodes}
    for n in nodes:
        at = inside[id(n)]
        assert n.own == sum(len(found[i][1]) for i in at) and n.links == sum(found[i][2] for i in at)
        assert n.mass == pytest.approx(sum(points[i] for i in at))
        score = 0.0
        for i in at:
            box = found[i][0]
            first = box.parent if box.tag in extract.PARAGRAPH and box.parent is not None else box
            chain = [id(m) for m in up(first)]
            if id(n) in chain:
                score += points[i] / 2 ** chain.index(id(n))
        assert n.score == pytest.approx(score)


def extract_factor(n):
    return n.weight / n.parent.weight if n.parent is not None else 1.0


def test_extraction_of_known_articles():
    r = random.Random(11)
    for _ in range(150):
        page, want = made_page(r)
        nodes = extract.parse(page)
        extract.score(nodes)
        plain_main_text(nodes)
        assert extract.main_text(page) == want


def test_names_never_decide_alone():
    text = " ".join(f"<p>Sentence {i} of it, with commas, and some length.</p>" for i in range(20))
    plain = re.sub("<[^>]+>", "", text)
    for name in HOSTILE:
        assert extract.main_text(f'<body><div class="{name}">{text}</div></body>') == plain
        got = extract.main_text(f'<body><div class="{name}">{text}</div><p>short one</p></body>')
        assert got == plain or name in ("widget", "menu") and got == plain + " short one"
    short = "<div id=x><p>A true article, short as it is, with commas, and so on.</p><p>Its second part, no longer, ends here.</p></div>"
    assert extract.main_text(f"{short}<div class=comments>{text}</div>") == re.sub("<[^>]+>", "", short.replace("</p><p>", " "))
    assert extract.main_text("<ul><li><a href=x>only</a></li><li><a href=y>links, here</a></li></ul>") == ""


def plain_signals(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    again = {k + j for k, g in enumerate(tri) if tri.count(g) > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_quality(spark):
    r = random.Random(8)
    texts = [None, "", " \n \n", "a b c a b c\na b c\na b c", "é😀 # x\u00a0y", " ".join(map(str, range(400))) * 2, *(prose(r, 90) for _ in range(6)), "\n".join(["same line here"] * 30 + [prose(r, 60)])]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6, 12)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.judge(docs, labels).collect()}
    for i, t in enumerate(texts):
        want = plain_signals(t)
        assert tuple(got[i][c] for c in quality.BASE_COLUMNS) == want
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert got[i]["kept"] == (not got[i]["base_failed"])  # too few labels prove no cutoff
    assert quality.judge(docs.limit(0), labels).count() == 0 and quality.judge(docs, labels.limit(0)).count() == len(texts)
    kept = quality.keep_good(docs.withColumnRenamed("fp", "stratum"), labels)  # clashing names, n_words among them
    assert kept.columns == ["doc_id", "text", "lang", "stratum", "n_words"] and {x["doc_id"] for x in kept.collect()} == {i for i, x in got.items() if x["kept"]} and {x["n_words"] for x in kept.collect()} == {1}
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_cutoffs_are_proven():
    assert quality.proven(1000, 0, 0.0125, 0.05) and not quality.proven(100, 0, 0.0125, 0.05) and not quality.proven(1000, 20, 0.0125, 0.05)
    assert abs(quality.binomial_tail(10, 3, 0.5) - 176 / 1024) < 1e-12


def test_rungs_are_tested_in_order(spark):
    n = len(quality.LADDER)
    assert all(x >= y for a, b in zip(quality.LADDER, quality.LADDER[1:]) for x, y in zip(a, b, strict=True))  # never looser
    assert quality.last_proven(86, [0] * n, 0.05, 0.0125) == n - 1 and quality.last_proven(85, [0] * n, 0.05, 0.0125) is None
    assert quality.last_proven(1000, [0, 10, 500, 10], 0.05, 0.0125) == 1  # what follows an unproven rung isn't looked at
    rows = [("en", 500, *([0] * n)), ("de", 500, 0, *([100] * (n - 1))), ("fr", 20, *([0] * n))]
    counts = spark.createDataFrame(rows, ["stratum", "n", *(f"r{j}" for j in range(n))])
    assert quality.choose_cutoffs(counts) == {"en": quality.LADDER[-1], "de": quality.LADDER[0]}


def test_promises_are_kept_in_simulation():
    """Strata whose true rates of false rejection lie around the risk: the promise breaks in few of many holdouts."""

    r, risk, error, broken, trials = np.random.default_rng(5), 0.05, 0.05, 0, 4000
    for _ in range(trials):
        wrong = False
        for rates in ([0.0, 0.01, 0.051, 0.06], [0.0501, 0.08, 0.1, 0.2], [0.02, 0.049, 0.0505, 0.3], [0.0, 0.0, 0.0, 0.0501]):
            n = int(r.integers(60, 900))
            cuts = np.sort(r.random(n))
            at = quality.last_proven(n, [int((cuts < p).sum()) for p in rates], risk, error / 4)
            wrong |= at is not None and rates[at] > risk
        broken += wrong
    assert broken <= trials * error + 3 * (trials * error) ** 0.5


def test_a_proven_rung_decides(spark):
    r = random.Random(9)
    good, junk = [prose(r, 70) for _ in range(90)], [" ".join(f"{w}##" for w in prose(r, 70).split()) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + junk)] + [(200, junk[0], "de"), (201, junk[0], None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 90)) for i in range(95)], "doc_id long, quality int")
    got = {x["doc_id"]: (x["base_failed"], x["kept"]) for x in quality.judge(docs, labels).collect()}
    assert got == {i: (False, i < 90 or i >= 200) for i in [*range(95), 200, 201]}  # strata without labels keep what passes the base rules
    assert {x["doc_id"] for x in quality.keep_good(docs, labels).collect()} == {i for i, v in got.items() if v[1]}
    old, quality.MAX_BROADCAST_KEYS = quality.MAX_BROADCAST_KEYS, 5
    try:
        assert quality.keep_good(docs, labels).count() == 92
    finally:
        quality.MAX_BROADCAST_KEYS = old
