"""Parsed entities are stored once per input file and reused when present."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from qaweave import schemas
from qaweave.operators.entities import build_entities
from qaweave.operators.quads import drop_url_lines, split_lines


def store_path(path: str, properties=None) -> str:
    """A selection of properties has a store of its own."""
    return f"{path}/{'all' if properties is None else '-'.join(sorted(properties))}"


def finished_files(spark: SparkSession, path: str, properties=None) -> DataFrame:
    """The manifest of the store: input files that were parsed to their end, with
    entities or without."""
    try:
        return spark.read.schema("file string").parquet(f"{store_path(path, properties)}/finished")
    except AnalysisException:
        return spark.createDataFrame([], "file string")


def checkpoint_entities(spark: SparkSession, lines: DataFrame, path: str,
                        properties=None, files: DataFrame | None = None) -> DataFrame:
    """Entities of all stored input files, those of `lines` that are new among them.

    Only lines of files that are not finished are parsed. A job puts the folders of its
    files in place when it ends, and then their names in the manifest; a job stopped
    before that leaves earlier files as they were and its own to be parsed again, in
    place of what it may have written. `files` (file) names what `lines` was read from,
    so that a file without a line is finished too; without it the lines are asked.
    """
    root = store_path(path, properties)
    done = finished_files(spark, path, properties)
    quads = split_lines(drop_url_lines(lines.join(done, "file", "left_anti")))
    (build_entities(quads, raw=True, properties=properties).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(f"{root}/entities"))
    names = (lines if files is None else files).select("file").distinct()
    names.join(done, "file", "left_anti").coalesce(1).write.mode("append").parquet(f"{root}/finished")
    columns = [c.split()[0] for c in schemas.ENTITIES.split(", ")]
    return spark.read.schema(schemas.ENTITIES).parquet(f"{root}/entities").select(*columns)
