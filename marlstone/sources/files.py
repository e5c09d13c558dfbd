"""Text files in and out: declared schemas, never inferred ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMS = "id bigint, date string, sender string, text string, is_from_me boolean, service string"
GOLD = "sms string, sender string, expected string"
SAMPLES = "sample_id bigint, run_id string, doc_id bigint, doc struct<sms:string,sender:string>, target string, resps array<array<string>>, filtered_resps array<string>"
RESULTS = "model_id string, quant string, thinking_budget bigint, n_ctx bigint, started_at timestamp_ntz, metrics map<string,double>"


def read_csv(spark: SparkSession, path: str, schema: str = SMS) -> DataFrame:
    """Quoted texts may hold line breaks; quotes are doubled; an empty field that was quoted is an empty text."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', nullValue="\\N", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=True, nullValue="\\N", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that are one array of objects each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """One object a line, characters as they are, nulls written."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_split(df: DataFrame, path: str, by: str = "split") -> None:
    """What would be the sheets of a workbook: one folder for each value."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def read_runs(spark: SparkSession, *roots: str) -> DataFrame:
    """``(slug, ts, model fields, metrics)`` of ``<slug>/results_<ts>.json`` below any of the roots.

    Unreadable and empty results are skipped, and so are results without a ``samples_<ts>.jsonl`` beside them.
    """
    opt = {"recursiveFileLookup": "true"}
    read = spark.read.schema(RESULTS + ", _bad string").options(**opt, pathGlobFilter="results_*.json", multiLine="true", columnNameOfCorruptRecord="_bad")
    at = F.col("_metadata.file_path")
    r = read.json(list(roots)).select("*", F.regexp_extract(at, r"([^/]+)/results_[^/]*$", 1).alias("slug"), F.regexp_extract(at, r"results_([^/]*)\.json$", 1).alias("ts"))
    r = r.where("_bad IS NULL AND metrics IS NOT NULL AND cardinality(metrics) > 0").drop("_bad")
    s = spark.read.format("binaryFile").options(**opt, pathGlobFilter="samples_*.jsonl").load(list(roots))
    s = s.select(F.regexp_extract("path", r"([^/]+)/samples_[^/]*$", 1).alias("slug"), F.regexp_extract("path", r"samples_([^/]*)\.jsonl$", 1).alias("ts")).distinct()
    return r.join(s, ["slug", "ts"], "left_semi")


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(path, modified_at, bytes)`` of the files below ``path``; contents aren't read."""
    f = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=glob).load(path)
    return f.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("bytes"))


def newest(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("path", F.struct("modified_at", "path")).alias("path"))


def smallest(files: DataFrame) -> DataFrame:
    return files.agg(F.min_by("path", F.struct("bytes", "path")).alias("path"))


def size_mb(paths: DataFrame, files: DataFrame) -> DataFrame:
    """``paths`` with their size in MB, 0 for files that aren't there."""
    return paths.join(files.select("path", "bytes"), "path", "left").select("path", F.coalesce(F.col("bytes") / 1048576, F.lit(0.0)).alias("mb"))


def copy(spark: SparkSession, source: str, target: str) -> None:
    """One file copied as it is, on any file system Spark knows."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
