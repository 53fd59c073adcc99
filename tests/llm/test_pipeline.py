import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliomill.llm import quality

from .test_op5_jaccard import brute
from .test_op6_quality import base
from .test_op8_pii import plain


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A small corpus with junk, copies, personal data, an extra column and a null text."""
    d = tmp_path_factory.mktemp("sf")
    good = [" ".join(f"w{(i * 37 + j * j * (i + 1)) % 4001}" for j in range(70 + i % 30)) for i in range(150)]
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(good)]
    rows += [(200 + i, good[i] + " tail", "en", "s1") for i in range(20)]
    rows += [(300 + i, "short text", "fr", "s2") for i in range(5)] + [(310, None, None, None)]
    rows += [(400 + i, good[60 + i] + f" mail me{i}@host.example.com +1 (017) 555-7713", "de", "s3") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows


def test_stages_one_by_one(spark, sf):
    d, rows = sf
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        out[name] = docs.collect()
    ids = {n: sorted(r["doc_id"] for r in x) for n, x in out.items()}
    kept = [r for r in rows if not base(r[1])[-1]]
    assert ids["quality rules"] == sorted(r[0] for r in kept)
    assert ids["n-gram Jaccard join"] == sorted({c for _, _, c in brute([r[0] for r in kept], [r[1] for r in kept])})
    assert ids["PII"] == ids["n-gram Jaccard join"]
    assert all(not plain(r["text"]) and r["n_chars"] == len(r["text"]) for r in out["PII"])
    assert set(ids["mixing"]) <= set(ids["PII"]) and max(map(ids["mixing"].count, ids["mixing"])) <= 3
    assert ids["byte-level BPE"] == ids["mixing"] and all(r["round_trip"] and len(r["tokens"]) == r["n_tokens"] for r in out["byte-level BPE"])


def test_run_equals_its_stages(spark, sf):
    d, _ = sf
    n = len(corpus_pipeline.STAGES) - 1
    key = lambda r: (r["doc_id"], r["n_tokens"], tuple(r["tokens"]))
    assert sorted(map(key, corpus_pipeline.run(spark, d).collect())) == sorted(map(key, spark.read.parquet(f"{d}/stage{n}").collect()))


def test_empty_documents(spark, sf, tmp_path):
    d, _ = sf
    spark.read.parquet(f"{d}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_labels_of_both_kinds_do_not_crash(spark, sf):
    d, _ = sf
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    assert quality.keep_documents(docs, labels.union(labels.selectExpr("doc_id", "0", "0"))).count() > 0
