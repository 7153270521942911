"""The corpus pipeline on the smallest table."""

import __spark_entry__ as E
import corpus_pipeline
from textguard.llm import context_pii, hyperminhash, quality_cascade


def test_stages_chain(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    good = corpus_pipeline.quality(spark, docs, sf001)
    verdict = {r["doc_id"]: r["kept"] for r in quality_cascade.judge(docs).collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i in ids if verdict[i]} and good.dtypes == docs.dtypes
    single = corpus_pipeline.near_dedup(spark, good, sf001)
    kept = {r["doc_id"] for r in hyperminhash.near_duplicates(good, 5, 80).collect() if r["kept"]}
    assert {r["doc_id"] for r in single.collect()} == kept and single.dtypes == docs.dtypes
    clean = corpus_pipeline.pii(spark, single, sf001)
    assert clean.dtypes == docs.dtypes and context_pii.report(clean).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    mixed = corpus_pipeline.mixing(spark, clean, sf001)
    assert mixed.dtypes == docs.dtypes and sorted(map(str, mixed.collect())) == sorted(map(str, clean.collect()))
    out = corpus_pipeline.run(spark, sf001)
    assert {r["doc_id"] for r in out.where("round_trip").collect()} == kept


def test_registered():
    names = E.queries()
    assert "pipeline" in names and [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == []
