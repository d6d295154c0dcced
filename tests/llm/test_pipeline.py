"""The pipeline against a plain version, and the SQL of the operators' queries, on the smallest tables."""

import math
import os

import pytest

import corpus_pipeline
from segrank.llm import bpe, quality, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def five_word_shingles(text):
    """Lower-cased words in fives; a shorter text is one shingle."""
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def ran(spark):
    return corpus_pipeline.run(spark, SF).collect()


def test_pipeline_follows_its_stages(spark, ran):
    from test_operators import plain_contamination, plain_signals

    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").collect()
    docs = {r["doc_id"]: r for r in read("documents")}
    kept = {}
    for i, r in docs.items():
        n, _, _, _, again = plain_signals(r["text"])
        if n >= 50 and 100 * again <= 50 * n:
            kept[i] = r
    judged = {r["doc_id"] for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert judged <= set(kept)
    sets = {i: five_word_shingles(docs[i]["text"]) for i in judged}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if root[a] != root[b] and 5 * (both := len(sets[a] & sets[b])) >= 4 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    alone = {i for i in sets if root[i] == i}
    bad = plain_contamination([(i, docs[i]["text"]) for i in alone], [(r["item_id"], r["text"]) for r in read("benchmark")])
    clean = {i for i in alone if not bad[i][4]}
    got = ran
    assert {r["doc_id"] for r in got} == clean and len(got) == len(clean)
    e = bpe.encoder(queries.tokenizer_path())
    redacted = {r["doc_id"]: r["text"] for r in corpus_pipeline.personal_data(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == e.digest(redacted[r["doc_id"]]) for r in got)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    got = sorted((tuple(plain(r[x]) for x in cols) for r in df.collect()), key=repr)
    assert got == sorted(map(tuple, c.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()), key=repr)


def test_stages_bear_nulls_empties_repeats_and_clashes(spark, ran, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(2)).unionByName(docs.limit(1).withColumn("text", F.lit(""))).unionByName(docs.limit(1).withColumns({c: F.lit(None).cast(docs.schema[c].dataType) for c in docs.columns}))
    extra = docs.unionByName(odd).withColumns({c: F.lit("x") for c in ("n_words", "stratum", "_t", "_base", "fp", "gram", "hits", "ids")})
    for name, df in (("odd", extra), ("none", extra.limit(0))):
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / name / f"{t}.parquet"))
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
    plain = {r["doc_id"] for r in ran}
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()]
    assert {i for i in got if i is not None} == plain
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
