"""Nulls in every column, empty and very long texts, ties, repeated rows, empty tables and clashing names, for operators and stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliomill.llm import common, jaccard, langid, mixing, pii, quality, quotes, sharding, simhash

NAMES = ["tokens", "n_tokens", "stratum", "kept", "_gone", "taken", "size", "fp", "bucket", "shard", "component_id", "d", "t", "n", "lang_pred", "spans", "votes", "target", "weight", "a", "b", "quota"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(60_000))
    body = " ".join(f"w{i * i % 89}x{i}" for i in range(60))
    rows = [(1, body, "en", "s", 1), (1, body, "en", "s", 1), (1, "other " + body[::-1], "en", None, 2), (None, body, "en", "s", 1), (None, None, None, None, None), (2, "", "fr", "s", 0), (3, None, "fr", "s", None), (4, long, None, "s", 5), (5, long, "de", "", 5), (6, "\0 \t\n", "de", "s", 3), (7, "ﬀ ß İ 😀 a@b.co " + body, "xx", "s", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)])
    d = str(tmp_path_factory.mktemp("odd"))
    df.repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, None, None), (2, None, 1), (4, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, odd, tmp_path):
    docs = common.read_table(spark, odd, "documents")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, odd)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
    assert docs.count() > 0 and docs.where("NOT round_trip").count() == 0


def test_operators_keep_every_row(spark, odd):
    docs, labels = common.read_table(spark, odd, "documents"), common.read_table(spark, odd, "labels")
    n = docs.count()
    made = {"quality": quality.assess(docs, labels), "mix": mixing.mix(docs), "simhash": simhash.edited_likeness(docs), "jaccard": jaccard.similar_components(docs), "langid": langid.identify(docs), "pii": pii.personal_data(docs)}
    for name, df in made.items():
        assert df.count() == n, name
    linked = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in made["jaccard"].collect()}
    assert {c for i, s, c in linked if i is None and s} == {1} and (None, 0, None) in linked and (5, 15138, 4) in {(i, s > 1000 and 15138, c) for i, s, c in linked}


def test_conversations_and_shards(spark):
    names = ["position", "parent_turn", "thread", "own", "quotes", "hash", "original", "shard", "place", "offset", "slot"]
    rows = [(1, 0, "u", "hello there"), (1, 0, "u", "hello there"), (1, 1, None, "> hello there\nfine"), (1, None, "u", "> hello there"), (None, 2, "u", None), (None, None, None, None), (2, 0, "", ""), (2, 1, "u", "> " + "long " * 50_000), (2, 2, "u", ">>> \n>> \n> ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    got = quotes.reply_order(df).collect()
    assert len(got) == len(rows) and sorted(r["parent_turn"] for r in got if r["parent_turn"] is not None) == [0]
    assert quotes.reply_order(df.where("false")).collect() == []
    table = sharding.build_table({"a": 1, "b": 2}, 101)
    assert sharding.place(df, ["conv_id", "text"], table).count() == len(rows) and sharding.place(df, ["conv_id"], table, ["turn"], 4).count() == len(rows)


def test_labels_without_rows(spark, odd):
    docs, labels = common.read_table(spark, odd, "documents"), common.read_table(spark, odd, "labels")
    assert quality.assess(docs, labels.where("false")).count() == docs.count()


class Session:
    """Just what shared_dir() asks of a session."""

    def __init__(self, master: str, **conf: str):
        self.sparkContext, self.conf = self, self
        self.master, self.getConf, self.get = master, lambda: conf, lambda k, d=None: conf.get(k, d)


def test_shared_folder_comes_from_the_session():
    assert common.shared_dir(Session("yarn", **{"spark.checkpoint.dir": "hdfs:///shared/"})) == "hdfs:///shared"
    assert common.shared_dir(Session("local[2]")) == common.LOCAL_CHECKPOINTS
    with pytest.raises(ValueError):
        common.shared_dir(Session("yarn"))


def test_without_treats_null_as_a_value(spark):
    df = spark.createDataFrame([(1,), (None,), (2,), (2,)], "doc_id long")
    assert sorted(r["doc_id"] for r in common.without(df, df.where("doc_id is null or doc_id = 1")).collect()) == [2, 2]
