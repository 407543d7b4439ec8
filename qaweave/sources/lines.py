"""Quad files and JSON-lines files."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from qaweave.session import stored

_BROKEN = "_corrupt_record"


def quad_files(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """(file, path) of all gz files with the prefix right in the folder; what lies in
    folders below it is not looked at. Files are listed, not opened."""
    escaped = re.sub(r"([\[\]{}*?\\])", r"\\\1", prefix)
    try:
        found = spark.read.format("binaryFile").load(f"{folder}/{escaped}*.gz").select("path")
    except AnalysisException:
        found = spark.createDataFrame([], "path string")
    return found.select(F.regexp_extract("path", r"([^/]*)\.gz$", 1).alias("file"), "path")


def read_quad_lines(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(file, pos, value) of the files in `files` (file, path; see `quad_files`). Their
    paths go through the driver, which lists them for the scan anyway.

    A gz file is one split, so the running id rises in line order inside a
    file. It is written out with the entities before anything is shuffled."""
    paths = [r.path for r in files.select("path").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], "file string, pos long, value string")
    return spark.read.text(paths).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.gz$", "").alias("file"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    fields = StructType.fromDDL(schema)
    wide = StructType(list(fields.fields)).add(_BROKEN, StringType())
    return lines.filter(F.trim("value") != "").select(
        F.from_json(
            "value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
        ).alias("r"),
        "value",
    )


def read_jsonl(spark: SparkSession, path, schema: str) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and the lines that are not JSON of the schema.

    Lines are read as text, so both results come from plain scans and no cache
    is needed."""
    rows = _parsed(spark.read.text(path), schema)
    broken = F.col("r").isNull() | F.col(f"r.{_BROKEN}").isNotNull()
    good = rows.filter(~broken).select("r.*").drop(_BROKEN)
    return good, rows.filter(broken).select(F.col("value").alias("line"))


def read_many(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Rows of all JSON-lines files that match a path pattern."""
    return read_jsonl(spark, pattern, schema)[0]


def _written_files(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, folder, file) of what `write_by_language` has written, from names alone."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    except AnalysisException:
        return None
    name = F.regexp_extract("path", r"/language=[^/]*/file=([^/]*)/[^/]*$", 1)
    return found.filter(name != "").select(
        "path", F.regexp_replace("path", r"/[^/]*$", "").alias("folder"),
        F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("file"))


def write_by_language(df: DataFrame, path: str, file_format: str = "json", files: DataFrame | None = None) -> None:
    """One folder per language and input file. The rows of an input file take the place of
    all its earlier ones, also of those in languages that it no longer has; other files
    stay. `files` (file) names the input files of this run, so that one that has no row
    any more loses its folders; without it, files with rows are replaced.

    Folders that get rows are replaced when the job ends, folders that got none are
    dropped after that. A run stopped in between leaves both, and the next one over the
    same files drops them. A task gets a range of (language, file, id), so folders get
    few files and a frequent language is split by id."""
    spark = df.sparkSession
    before = _written_files(spark, path)
    before = None if before is None else stored(before, "written-files")
    (df.repartitionByRange("language", "file", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("language", "file").format(file_format).save(path))
    if before is None:
        return
    now = _written_files(spark, path)
    mine = now.join(before.select("path"), "path", "left_anti").select("file")
    if files is not None:
        mine = mine.unionByName(files.select("file"))
    left = now.join(before.select("path"), "path", "left_semi").join(mine, "file", "left_semi")
    # Only folders of languages that a file lost.
    for r in left.select("folder").distinct().collect():
        _drop_folder(spark, r.folder)


def _drop_folder(spark: SparkSession, folder: str) -> None:
    """Through the file system of the path, so that shared stores work as well."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_merged(df: DataFrame, path: str) -> None:
    """Rows in merge order with their position written down, per language."""
    df.withColumn("pos", F.monotonically_increasing_id()).write.mode("overwrite").partitionBy(
        "language"
    ).parquet(path)


def write_bitexts(bitexts: DataFrame, path: str) -> None:
    """One folder per language pair, rows in order of the first url.

    The range exchange includes the url and texts, so a frequent pair becomes
    several files, sorted inside and from file to file."""
    first_url = F.col("details.urls")[0]
    keys = [F.col("pair"), first_url, F.col("question1"), F.col("question2")]
    bitexts.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(
        "overwrite"
    ).partitionBy("pair").json(path)
