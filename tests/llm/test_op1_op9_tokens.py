import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliomill.llm import bpe, token_table

TEXTS = ["", None, "Hello world", "  two  spaces \n\n and lines\n ", "<|endoftext|> inside", "naïve 漢字 😀 ١٢", "x" * 50_000, "it's we'll 'S", "a b " * 9000, "tab\there", " lead", "trail "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "z", 7) for i, t in enumerate(TEXTS)] + [(3, "again", "z", 7), (None, "no id", "z", 7)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens int").repartition(3)


def test_token_table_equals_the_library(spark, docs):
    got = token_table.encode_and_digest(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert len(got) == len(TEXTS) + 2
    got.sort(key=lambda r: r["start"])
    assert got[0]["doc_id"] is None and [r["doc_id"] for r in got[1:]] == sorted([*range(len(TEXTS)), 3])
    start, pool = 0, {}
    for i, x in [(None, "no id"), (3, "again"), *enumerate(TEXTS)]:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        pool.setdefault(i, set()).add((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    for r in got:
        assert r["start"] == start and (r["n_tokens"], r["ids_crc32"]) in pool[r["doc_id"]]
        start += r["n_tokens"]


def test_files_are_ordered_and_selective(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    path = f"{tmp_path}/t"
    token_table.write_tokens(docs, path, P.path("byte_bpe_50k.json"), P.PATTERN)
    for f in (tmp_path / "t").glob("*.parquet"):
        m = pq.ParquetFile(f).metadata
        if m.num_rows:
            col = {m.row_group(0).column(c).path_in_schema: m.row_group(0).column(c) for c in range(m.num_columns)}
            assert "RLE_DICTIONARY" in col["tokens.list.element"].encodings and "DELTA_BINARY_PACKED" in col["n_tokens"].encodings
            assert col["doc_id"].has_column_index and col["doc_id"].has_offset_index
    some = token_table.read_tokens(spark, path, ["doc_id", "n_tokens"], (2, 4))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "tokens" not in plan.split("ReadSchema")[1].replace("n_tokens", "") and "GreaterThanOrEqual(doc_id,2)" in plan
    assert sorted(r["doc_id"] for r in some.collect()) == [2, 3, 3, 4]


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert token_table.encode_and_digest(none, P.path("byte_bpe_50k.json"), P.PATTERN).collect() == []
    assert bpe.round_trip_digests(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect() == []


def test_two_tier_bpe_equals_tiktoken(spark, docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(path))}, special_tokens={})
    want = {(i, hashlib.sha256(",".join(map(str, enc.encode_ordinary(x or ""))).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()) for i, x in [(None, "no id"), (3, "again"), *enumerate(TEXTS)]}
    assert {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip_digests(docs, path, P.PATTERN).collect()} == want
    tokens = bpe.encode(docs, path, P.PATTERN)
    back = {(r["doc_id"], bytes(r["raw"]).decode()) for r in bpe.decode(tokens, path, P.PATTERN).collect()}
    assert back == {(i, x or "") for i, x in [(None, "no id"), (3, "again"), *enumerate(TEXTS)]}


def test_perfect_hash_is_minimal_and_exact():
    keys = [str(i).encode() for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert [table.find(k) for k in keys] == list(range(5000)) and sorted(table.at) == list(range(5000))
    assert all(table.find(f"x{i}".encode()) == -1 for i in range(2000)) and bpe.PerfectHash([]).find(b"a") == -1


def test_random_strings_on_both_encoders():
    js = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    library, own = Tokenizer.from_str(js), token_table.make_encoder(js, P.PATTERN)
    tokens = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc, two = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={}), bpe.TwoTierBPE(tokens, bpe.PerfectHash(tokens), P.PATTERN)
    r = random.Random(5)
    ids, at = two.encoder.encode_many(pa.array(["a b c", "", "x  y", "the cat, sat. on;"]), b"\1\0\0\0")
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*enc.encode_ordinary(t), 1] for t in ("a b c", "", "x  y", "the cat, sat. on;")]
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    pair = f"q {word} and {word.translate(str.maketrans('ab', 'ba'))} end"  # equal under any polynomial hash with an odd step
    assert own(pa.array([pair]), b"")[0].tolist() == library.encode(pair, add_special_tokens=False).ids
    assert two.encode(pair).tolist() == enc.encode_ordinary(pair)
    planes = (0x80, 0x800, 0x3000, 0x10000, 0x20000, 0x110000)
    wild = ["".join(r.choice(" \n\t a1.") if r.random() < 0.3 else chr(c) for c in (r.randrange(r.choice(planes)) for _ in range(r.randrange(1, 16))) if not 0xD800 <= c < 0xE000) for _ in range(20_000)]
    for encode, want in ((lambda x: own(x, b""), [e.ids for e in library.encode_batch(wild, add_special_tokens=False)]), (two.encoder.encode_many, enc.encode_ordinary_batch(wild))):
        ids, at = encode(pa.array(wild))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    parts = [" ", "  ", "\n", " \n", "\t", " ", "　", "a", "the", "é", "漢字", "²", "'s", "'S", "!?", "😀", "́", "_", "42"]
    for _ in range(3000):
        s = "".join(r.choice(parts) for _ in range(r.randrange(20)))
        assert own(pa.array([s]), b"")[0].tolist() == library.encode(s, add_special_tokens=False).ids
        assert two.encode(s).tolist() == enc.encode_ordinary(s)


def test_pieces_of_one_hash_are_told_apart():
    from foliomill.llm.pretokens import _Known

    known = _Known(10)
    raw = np.frombuffer(b"abcd" + b"abcx" + b"ab", dtype=np.uint8)
    h, at = np.array([7, 7, 7], dtype=np.uint64), np.array([0, 4, 8, 10])
    off, n = known.add(h[:1], [b"abcd"], [b"\1\0\0\0\2\0\0\0"])
    got = known.find(h, raw, at)
    assert got[0].tolist() == [off[0], -1, -1] and got[1].tolist() == [2, 0, 0]


def test_a_text_larger_than_a_slice(spark):
    text = "The quick brown fox, jumps over 13 dogs. " * 110_000
    df = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    tokens = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    assert got[1]["n_tokens"] == len(enc.encode_ordinary(text)) and got[1]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    sums = {r["doc_id"]: r["n_tokens"] for r in token_table.encode_and_digest(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect()}
    assert sums[1] == len(Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids) + 1


def test_copied_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a", "b", 2)], "doc_id long, text string, tokens string, shard int")
    assert bpe.encode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).columns == ["doc_id", "tokens"]
    assert token_table.encode_and_digest(df.withColumn("x", F.lit(1)), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 1
