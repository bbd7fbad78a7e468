"""The corpus pipeline, stage by stage, against plain versions."""

import brute
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from fieldtally.llm import packing, pii


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "pii", "best_fit_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)

    docs = stages["language_id"](spark, docs, folder).cache()
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert docs.columns == columns and len(kept) >= 0.97 * len(before)

    groups = brute.op5(kept.items(), 5, 80)
    docs = stages["ngram_jaccard"](spark, docs, folder).cache()
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert docs.columns == columns and set(kept) == {d for d, (_, c) in groups.items() if c == d}

    hits = brute.op4(kept.items(), benchmark)
    docs = stages["decontamination"](spark, docs, folder).cache()
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert docs.columns == columns and set(kept) == {d for d, v in hits.items() if not v[-1]}

    docs = stages["pii"](spark, docs, folder).cache()
    masked = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert docs.columns == columns and set(masked) == set(kept)
    assert all(sum(v[:4]) == 0 for v in brute.op7(masked.items()).values())
    plain = {d for d, v in brute.op7(kept.items()).items() if not sum(v[:4])}
    assert sum(masked[d] != kept[d] for d in plain) <= 0.1 * len(plain)

    encode = packing.Encoder(packing.default_vocabulary())
    packed = stages["best_fit_packing"](spark, docs, folder)
    lengths = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert lengths == {d: len(encode(t)) // 4 + 1 for d, t in masked.items()}


def test_run_and_registry(spark, folder):
    assert "pipeline" in entry.queries() and len([n for n in entry.queries() if n.startswith("op")]) == 13
    packed = corpus_pipeline.run(spark, folder)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert pii.KINDS == ("email", "ip", "card", "phone")
