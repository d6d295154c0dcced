"""Chains of overlapping candidates: what only a dropped span covers stays."""

from pyspark.sql import functions as F

from segrank.llm import pii


def test_chain_of_overlaps(spark, monkeypatch):
    chain = "array(" + ", ".join(f"named_struct('start', {s}, 'end', {e}, 'rank', 0)" for s, e in ((0, 5), (4, 9), (8, 12), (12, 14))) + ")"
    monkeypatch.setattr(pii, "train", lambda *_: {0: ([1.0], 0.0)})
    monkeypatch.setattr(pii, "with_candidates", lambda df: df.withColumn("_cand", F.expr(chain)))
    docs = spark.createDataFrame([(1, "a plain text without spans")], "doc_id long, text string")
    assert pii.personal_data(docs).first()["spans"] == ",".join(f"{pii.KINDS[0]}:{s}:{e}" for s, e in ((0, 5), (8, 12), (12, 14)))
