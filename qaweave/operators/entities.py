"""Quads to entities, entities to question-answer rows.

Entities are kept one row per property value, with the entity's type and order
beside it. Nothing is collected, so an entity of any size is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaweave.constants import (
    ANSWER_TYPE,
    PAGE_TYPE,
    QUESTION_TYPE,
    SCHEMA_ROOTS,
    TYPE_PREDICATES,
)
from qaweave.functions.text import strip_angles
from qaweave.operators.quads import decode_objects

_KEY = ["file", "graph", "subject"]
QA_PROPERTIES = ("name", "acceptedAnswer", "text", "mainEntity")


def _types(*names: str) -> list[str]:
    return [root + name for name in names for root in SCHEMA_ROOTS]


def is_property(predicate: str, *names: str) -> Column:
    """Property names are compared without case, under both roots."""
    return F.lower(predicate).isin([t.lower() for t in _types(*names)])


def keep_types(entities: DataFrame) -> DataFrame:
    return entities.filter(F.col("type").isin(_types(PAGE_TYPE, QUESTION_TYPE, ANSWER_TYPE)))


def build_entities(quads: DataFrame, raw: bool = False, properties=None) -> DataFrame:
    """One row per property value of every entity that has a type.

    The last type counts, the first quad fixes the entity's order. The quads are read once:
    one exchange by entity, and one sorted group that tells its last type and first place
    to each of its rows (a group beyond memory goes on on disk). With `raw` the objects are
    still as written and are decoded only where used: types of kept entities and their
    values; what other properties say is not moved."""
    is_type = F.col("predicate").isin(list(TYPE_PREDICATES))
    wanted = ~is_type if properties is None else ~is_type & is_property("predicate", *properties)
    entity = Window.partitionBy(*_KEY)
    rows = quads.select(
        *_KEY, "pos", "predicate", F.when(is_type | wanted, F.col("object")).alias("object"),
        F.when(is_type, F.col("pos")).alias("_type_pos"), wanted.alias("_wanted"),
    ).withColumns({
        "type": F.max_by("object", "_type_pos").over(entity), "_first": F.min("pos").over(entity),
    }).filter(F.col("_wanted") & F.col("type").isNotNull()).select(
        *_KEY, F.col("_first").alias("pos"), "type", "predicate", F.col("pos").alias("value_pos"), F.col("object").alias("value"))
    if not raw:
        return keep_types(rows)
    # Most types are names between angles and need no decoding to be told from the kept ones.
    named = F.col("type").startswith('"') | strip_angles(F.col("type")).isin(_types(PAGE_TYPE, QUESTION_TYPE, ANSWER_TYPE))
    return decode_objects(keep_types(decode_objects(rows.filter(named), "type")), "value")


def page_main_entities(entities: DataFrame) -> DataFrame:
    """Subjects that the pages of a graph name as main entities."""
    return (
        entities.filter(F.col("type").isin(_types(PAGE_TYPE)))
        .filter(is_property("predicate", "mainEntity"))
        .select("file", "graph", F.col("value").alias("subject"))
        .distinct()
    )


def _first_values(entities: DataFrame, kind: str, **wanted: str) -> DataFrame:
    """Per entity the first value of each wanted property. Spellings of one
    property are properties of their own; the one first seen last counts."""
    firsts = (
        entities.filter(F.col("type").isin(_types(kind)))
        .filter(is_property("predicate", *wanted.values()))
        .groupBy(*_KEY, "pos", "predicate")
        .agg(
            F.min("value_pos").alias("first_pos"),
            F.min_by("value", "value_pos").alias("first_value"),
        )
    )
    picked = [
        F.max_by(
            "first_value", F.when(is_property("predicate", name), F.col("first_pos"))
        ).alias(alias)
        for alias, name in wanted.items()
    ]
    return firsts.groupBy(*_KEY, "pos").agg(*picked).dropna(subset=list(wanted))


def questions(entities: DataFrame) -> DataFrame:
    return _first_values(
        entities, QUESTION_TYPE, question="name", answer_subject="acceptedAnswer"
    )


def questions_last_wins(found: DataFrame) -> DataFrame:
    """Equal question texts of a graph: the later entity stands, at the place of
    the first."""
    return found.groupBy("file", "graph", "question").agg(
        F.max_by("subject", "pos").alias("subject"),
        F.max_by("answer_subject", "pos").alias("answer_subject"),
        F.min("pos").alias("pos"),
    )


def answers(entities: DataFrame) -> DataFrame:
    return _first_values(entities, ANSWER_TYPE, answer="text").select(
        "file", "graph", F.col("subject").alias("answer_subject"), "answer"
    )


def join_qa(found: DataFrame, main: DataFrame, answered: DataFrame) -> DataFrame:
    return found.join(main, _KEY, "left_semi").join(
        answered, ["file", "graph", "answer_subject"]
    )
