"""Quad lines to quads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaweave.constants import URL_PROPERTIES
from qaweave.functions.text import decode_literals, strip, strip_angles

# The line format. Three blanks stand before the final dot.
_SUBJECT = r"(<[^>]+>|_:[a-zA-Z0-9]+)"
_PREDICATE = r"(<[^>]+>)"
_OBJECT = r'(<[^>]+>|".*"(?:\^\^<[^>]+>)?(?:@\S+(?:\sclass=)?)?|_:[a-zA-Z0-9]+)'
_GRAPH = r"(<[^>]+>)"
LINE_PATTERN = rf"(?sU)\A{_SUBJECT}\s{_PREDICATE}\s{_OBJECT}\s{_GRAPH}\s\s\s\.\z"


def drop_url_lines(lines: DataFrame) -> DataFrame:
    """Drop lines that hold one of the url property names anywhere."""
    for name in URL_PROPERTIES:
        lines = lines.filter(~F.col("value").contains(name))
    return lines


def split_lines(lines: DataFrame) -> DataFrame:
    """The four parts as written; lines of another form are dropped.

    One pattern run per line: the parts come back on lines of their own, which a
    single input line can never hold. The generator keeps the optimizer from
    running the pattern once for the filter and again for the parts."""
    parts = F.split(F.regexp_replace(strip(F.col("value")), LINE_PATTERN, "\n$1\n$2\n$3\n$4"), "\n")
    matched = F.filter(F.array(parts), lambda p: F.size(p) == 5)
    return lines.select("file", "pos", F.explode(matched).alias("p")).select(
        "file",
        "pos",
        strip_angles(F.col("p")[4]).alias("graph"),
        strip_angles(F.col("p")[1]).alias("subject"),
        strip_angles(F.col("p")[2]).alias("predicate"),
        F.col("p")[3].alias("object"),
    )


def parse_quads(lines: DataFrame) -> DataFrame:
    """Lines (file, pos, value) to quads with decoded objects."""
    return decode_objects(split_lines(drop_url_lines(lines)), "object")


def decode_objects(df: DataFrame, column: str) -> DataFrame:
    return decode_literals(df, column).withColumn(column, strip_angles(F.col(column)))
