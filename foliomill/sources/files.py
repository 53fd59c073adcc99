"""Files as sources and sinks: listings, registries and label modules in JSON, manifests, dumps, pending keys and packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def find_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, length of the files below folder whose name fits the pattern; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")


def read_registry(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A contents registry (JSON with pages, whitelist and waivers) as tables: pages (stem, page), whitelist (pattern), waivers (gate, fragment)."""
    whole = spark.read.option("multiLine", True).schema("PAGES map<string,array<long>>, WL array<string>, WAIVE array<array<string>>").json(path)
    pages = whole.select(F.explode("PAGES").alias("stem", "p")).select("stem", F.explode("p").alias("page"))
    waive = whole.select(F.explode("WAIVE").alias("w")).select(F.col("w")[0].alias("gate"), F.col("w")[1].alias("fragment"))
    return {"pages": pages, "whitelist": whole.select(F.explode("WL").alias("pattern")), "waivers": waive}


def read_labels(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A label module (JSON) as tables: labels (figure, box, text), bubbles (figure, box), like (figure, of), scale (figure, factor)."""
    whole = spark.read.option("multiLine", True).schema("LABELS map<string,map<string,string>>, BUBBLES map<string,array<int>>, BUBBLE_LIKE map<string,string>, FONT_SCALE map<string,double>").json(path)
    labels = whole.select(F.explode("LABELS").alias("figure", "m")).select("figure", F.explode("m").alias("box", "text")).select("figure", F.col("box").cast("int").alias("box"), "text")
    bubbles = whole.select(F.explode("BUBBLES").alias("figure", "b")).select("figure", F.explode("b").alias("box"))
    return {"labels": labels, "bubbles": bubbles, "like": whole.select(F.explode("BUBBLE_LIKE").alias("figure", "of")), "scale": whole.select(F.explode("FONT_SCALE").alias("figure", "factor"))}


def read_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """stem, batch, key, value of dictionary modules: JSON maps in files stem_batch.json. A null value is a miss, an empty one keeps the text."""
    whole = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("name"), "value")
    part = lambda k: F.regexp_extract("name", r"^(.*)_(\d+)\.json$", k)
    rows = whole.select(part(1).alias("stem"), part(2).cast("int").alias("batch"), F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    return rows


def verified(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """files (name, content binary) with ok: whether their SHA-256 is the one that wanted (name, sha) asks; files nobody asks for are not ok."""
    w = wanted.select("name", F.lower("sha").alias("_sha"))
    return files.join(w, "name", "left").withColumn("ok", F.coalesce(F.sha2("content", 256) == F.col("_sha"), F.lit(False))).drop("_sha")


def waived(entries: DataFrame, waivers: DataFrame) -> DataFrame:
    """entries (gate, text, ...) that no waiver covers: its gate is a beginning of theirs and its fragment is in their text."""
    w = waivers.select(F.col("gate").alias("_gate"), F.col("fragment").alias("_fragment"))
    return entries.join(F.broadcast(w), F.col("gate").startswith(F.col("_gate")) & F.col("text").contains(F.col("_fragment")), "left_anti")


def write_if_absent(df: DataFrame, path: str) -> None:
    """Writes df unless path is there already, which then stays as it is."""
    df.write.mode("ignore").parquet(path)


def write_manifest(new: DataFrame, path: str, key: str) -> DataFrame:
    """Adds the rows of new whose key the manifest at path lacks; rows that are there stay. No rows at all are an error."""
    spark = new.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    rows = new.dropDuplicates([key])
    added = rows.join(spark.read.parquet(path).select(key), key, "left_anti") if there else rows
    if not new.limit(1).count():
        raise ValueError("a manifest without rows is an error")
    added.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_dump(dumps: DataFrame, path: str, key: str = "doc_id", text: str = "dump") -> None:
    """One text file a task and key: dumps (key, ..., text) as lines of folders key=value, so that a document's dump is read alone."""
    dumps.select(key, text).write.partitionBy(key).mode("overwrite").text(path)


def write_pending(keys: DataFrame, path: str, longest: int | None = None) -> dict[str, int]:
    """Keys (first_page, text, n) as text files in order of page and length; returns what it wrote and left out as too long."""
    kept = keys if longest is None else keys.where(F.length("text") <= longest)
    line = F.concat_ws("\t", F.col("first_page").cast("string"), F.col("n").cast("string"), "text")
    order = ["first_page", F.length("text"), "text"]
    kept.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("value")).write.mode("overwrite").text(path)
    count = keys.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") > (longest if longest is not None else 1 << 30)).alias("long")).first()
    return {"written": count["n"] - count["long"], "left_out": count["long"]}


def packages(files: DataFrame, key: str) -> DataFrame:
    """key, package (a zip archive) of files (key, name, content binary): one archive a key, entries in order of name, equal for equal files."""
    import io
    import zipfile

    import pandas as pd

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in group.sort_values("name").itertuples():
                z.writestr(zipfile.ZipInfo(r.name), bytes(r.content))
        return pd.DataFrame({key: [group[key].iloc[0]], "package": [out.getvalue()]})

    kind = dict(files.dtypes)[key]
    return files.select(key, "name", "content").groupBy(key).applyInPandas(pack, f"{key} {kind}, package binary")


def version_conflicts(texts: DataFrame, pattern: str = r"version\s*[:=]\s*[\"']?([0-9.]+)") -> DataFrame:
    """path, version of files (path, text) that name another version than most files do; ties go to the higher one."""
    found = texts.select("path", F.regexp_extract("text", pattern, 1).alias("version")).where("version <> ''")
    best = found.groupBy("version").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("version", F.struct("n", "version")).alias("best"))
    return found.join(F.broadcast(best), F.col("version") != F.col("best")).drop("best")

