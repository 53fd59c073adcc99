"""Sources and sinks on small folders."""

import io
import json
import zipfile

import pytest

from foliomill.sources import files


def test_find_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for n in ("build_x.py", "a/build_y.py", "other.py"):
        (tmp_path / n).write_text("x")
    assert sorted(r["name"] for r in files.find_files(spark, str(tmp_path), "build_*.py").collect()) == ["build_x.py", "build_y.py"]


def test_registry_and_waivers(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"PAGES": {"a": [1, 3], "b": []}, "WL": ["^API"], "WAIVE": [["G", "pump"], ["A", ""]]}))
    r = files.read_registry(spark, str(tmp_path / "r.json"))
    assert sorted((x["stem"], x["page"]) for x in r["pages"].collect()) == [("a", 1), ("a", 3)] and r["whitelist"].count() == 1
    e = spark.createDataFrame([("G1", "a pump"), ("G1", "a valve"), ("A", "any"), ("B", "pump")], "gate string, text string")
    assert sorted(tuple(x) for x in files.waived(e, r["waivers"]).collect()) == [("B", "pump"), ("G1", "a valve")]


def test_labels(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"LABELS": {"f": {"0": "甲", "2": "乙"}}, "BUBBLES": {"f": [1]}, "BUBBLE_LIKE": {"g": "f"}, "FONT_SCALE": {"f": 0.9}}))
    r = files.read_labels(spark, str(tmp_path / "l.json"))
    assert sorted((x["figure"], x["box"], x["text"]) for x in r["labels"].collect()) == [("f", 0, "甲"), ("f", 2, "乙")]
    assert [tuple(x) for x in r["bubbles"].collect()] == [("f", 1)] and [tuple(x) for x in r["like"].collect()] == [("g", "f")] and r["scale"].count() == 1


def test_written_once_and_manifests(spark, tmp_path):
    one, two = spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k long, v string")
    files.write_if_absent(one, f"{tmp_path}/once")
    files.write_if_absent(two, f"{tmp_path}/once")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/once").collect()] == [(1, "a")]
    files.write_manifest(one, f"{tmp_path}/m", "k")
    assert sorted(tuple(r) for r in files.write_manifest(two, f"{tmp_path}/m", "k").collect()) == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError):
        files.write_manifest(one.where("false"), f"{tmp_path}/m", "k")


def test_dumps_pending_and_packages(spark, tmp_path):
    d = spark.createDataFrame([(1, "x\ny"), (2, "z")], "doc_id long, dump string")
    files.write_dump(d, f"{tmp_path}/d")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/d/doc_id=1").collect()) == ["x", "y"]
    keys = spark.createDataFrame([(2, "aa", 1), (1, "bbb", 3), (1, "c", 2), (1, "far too long", 1)], "first_page long, text string, n long")
    assert files.write_pending(keys, f"{tmp_path}/p", 5) == {"written": 3, "left_out": 1}
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/p").collect()].count("1\t2\tc") == 1
    f = spark.createDataFrame([("a", "2.txt", b"two"), ("a", "1.txt", b"one"), ("b", "3.txt", b"")], "stem string, name string, content binary")
    got = {r["stem"]: zipfile.ZipFile(io.BytesIO(bytes(r["package"]))) for r in files.packages(f, "stem").collect()}
    assert got["a"].namelist() == ["1.txt", "2.txt"] and got["a"].read("2.txt") == b"two" and got["b"].namelist() == ["3.txt"]
    v = spark.createDataFrame([("a", "version: 1.2"), ("b", 'version = "1.3"'), ("c", "version: 1.2"), ("d", "none")], "path string, text string")
    assert [tuple(r) for r in files.version_conflicts(v).collect()] == [("b", "1.3")]


def test_dictionary_modules_and_checked_files(spark, tmp_path):
    (tmp_path / "main_1.json").write_text(json.dumps({"A": "甲", "B": None, "C": ""}))
    (tmp_path / "main_2.json").write_text(json.dumps({"B": "乙"}))
    got = sorted(((r["stem"], r["batch"], r["key"], r["value"]) for r in files.read_dictionary(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([("main", 1, "A", "甲"), ("main", 1, "B", None), ("main", 1, "C", ""), ("main", 2, "B", "乙")], key=str)
    import hashlib

    f = spark.createDataFrame([("w", b"one"), ("x", b"two"), ("y", b"")], "name string, content binary")
    w = spark.createDataFrame([("w", hashlib.sha256(b"one").hexdigest().upper()), ("x", "00")], "name string, sha string")
    assert {r["name"]: r["ok"] for r in files.verified(f, w).collect()} == {"w": True, "x": False, "y": False}
