"""Quad lines to question-answer rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from qaweave.operators.clean import (
    add_id,
    add_scheme_host,
    clean_pairs,
    detect_language,
    qa_filters,
)
from qaweave.operators.dedup import dedup_exact
from qaweave.operators.entities import (
    answers,
    join_qa,
    page_main_entities,
    questions,
    questions_last_wins,
)
from qaweave.constants import LANGUAGE_CONFIDENCE


def qa_rows(entities: DataFrame) -> DataFrame:
    """Stored entities to cleaned rows (file, pos, url, scheme_host, question,
    answer). Cheap JVM filters stand before the cleaning expressions."""
    found = questions_last_wins(questions(entities))
    joined = join_qa(found, page_main_entities(entities), answers(entities))
    rows = qa_filters(joined).select("file", "pos", joined["graph"].alias("url"),
                                     "question", "answer")
    return clean_pairs(add_scheme_host(rows))


def extract_faq(entities: DataFrame, detector,
                limit: float = LANGUAGE_CONFIDENCE) -> DataFrame:
    """The whole chain after the entity store: language, id and the first row per
    id of an input file."""
    rows = add_id(detect_language(qa_rows(entities), detector, limit))
    kept = dedup_exact(rows, ["file"], ["url", "pos"])
    return kept.select("id", "url", "scheme_host", "language", "confidence", "question",
                       "answer", "file", "pos")
