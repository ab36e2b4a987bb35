"""Line, JSON and image files: reading what earlier runs left, and writing what this one finds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.match import strip
from quarrylight.operators import relational as R

FIND = "kind string, text string, url string, domain string, score int, tags array<string>, ts string"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


# --- sources ------------------------------------------------------------------------------------
def lines(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """(line): lines without blanks at the ends; blank lines, and with ``comments`` those that begin with ``#``, left out. A missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], "line string")
    rows = spark.read.text(path).select(strip(F.col("value")).alias("line")).where("line <> ''")
    return rows.where(~F.col("line").startswith("#")) if comments else rows


def seeds(spark: SparkSession, arguments: list[str]) -> list[str]:
    """Seeds from a file, if the one argument is one, else the arguments themselves."""
    if len(arguments) == 1 and exists(spark, arguments[0]):
        return [r.line for r in lines(spark, arguments[0]).collect()]
    return [a.strip() for a in arguments if a.strip()]


def finds(spark: SparkSession, path: str) -> DataFrame:
    """Finds of a JSON-lines file; blank and broken lines are left out, a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], FIND)
    parsed = spark.read.text(path).select(F.from_json("value", f"{FIND}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return parsed.where("r IS NOT NULL AND r._broken IS NULL").select("r.*").drop("_broken")


def completed(spark: SparkSession, path: str) -> list[str]:
    """Domains a state file names as done; a missing or broken file names none."""
    try:
        text = "\n".join(r[0] for r in spark.read.text(path).collect())
        return sorted(json.loads(text)["completed_domains"])
    except Exception:
        return []


def image_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of all files below a folder."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, sha256 string")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


# --- sinks --------------------------------------------------------------------------------------
def add_findings(findings: DataFrame, path: str) -> None:
    """Append findings, by category: detail as text, NULL as empty text."""
    rows = findings.select("netloc", "category", "url", F.coalesce(F.col("detail").cast("string"), F.lit("")).alias("detail"), *(F.col(c) if c in findings.columns else F.lit(None).cast("string").alias(c) for c in ("found_on", "kind")))
    rows.write.mode("append").partitionBy("category").parquet(path)


def append_new_lines(rows: DataFrame, column: str, path: str) -> int:
    """Append the lines of a column that the files of ``path`` don't have yet, each once; returns how many."""
    spark = rows.sparkSession
    fresh = rows.select(F.col(column).alias("line")).where("line IS NOT NULL AND line <> ''").distinct()
    fresh = R.unseen(fresh, lines(spark, path, comments=False), ["line"]).persist()
    n = fresh.count()
    if n:
        fresh.select(F.col("line").alias("value")).write.mode("append").text(path)
    fresh.unpersist()
    return n


def add_finds(new: DataFrame, path: str, most_per_domain: int = 0) -> None:
    """Append finds to JSON lines: those whose key is new, up to a cap a domain, earlier runs counted."""
    from quarrylight.functions.text import find_key

    spark, key = new.sparkSession, find_key(F.col("kind"), F.col("text"), F.col("domain"))
    old = finds(spark, path).withColumn("_key", key)
    rows = R.unseen(R.first_per_key(new.withColumn("_key", key), ["_key"], ["ts", "text"]), old, ["_key"])
    if most_per_domain:
        used = old.groupBy("domain").agg(F.count(F.lit(1)).alias("_used"))
        kept = R.cap_per_group(rows, ["domain"], ["ts", "_key"], most_per_domain, rank="_place").join(used, "domain", "left")
        rows = kept.where(F.col("_place") + F.coalesce("_used", F.lit(0)) <= most_per_domain).drop("_used", "_place")
    rows.select(*(c.split()[0] for c in FIND.split(", "))).write.mode("append").json(path)


def save_frontier(queue: DataFrame, path: str, order: list[str]) -> None:
    """Replace the snapshot of addresses still to be visited, in order."""
    queue.orderBy(*order).select(F.col("url").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def save_completed(spark: SparkSession, path: str, domains: list[str]) -> None:
    """Replace the state file; no domains remove it."""
    fs, at = _fs(spark, path)
    if not domains:
        fs.delete(at, False)
        return
    out = fs.create(at, True)
    out.write(bytearray(json.dumps({"completed_domains": sorted(domains)}, indent=2).encode()))
    out.close()


def save_images(images: DataFrame, folder: str) -> DataFrame:
    """Write image bytes (site, file_name, body) below ``folder`` from the tasks that hold them; returns the manifest."""

    def write(rows):
        import os

        for r in rows:
            at = os.path.join(folder, r.site)
            os.makedirs(at, exist_ok=True)
            draft = os.path.join(at, f".{r.file_name}.{os.getpid()}")
            with open(draft, "wb") as f:
                f.write(r.body)
            os.replace(draft, os.path.join(at, r.file_name))  # a task that runs twice writes the same file

    images.select("site", "file_name", "body").foreachPartition(write)
    return images.select("image_url", "found_on", F.concat(F.lit(f"{folder}/"), "site", F.lit("/"), "file_name").alias("saved_path"))


def upsert_meta(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, value) with the changes in place of older values."""
    return meta.join(changes, "key", "left_anti").unionByName(changes)


def visible_rows_tsv(rows: DataFrame, path: str) -> None:
    """Report rows as tab-separated text with a header."""
    rows.select("category", "detail", "url", "found_on").write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)
