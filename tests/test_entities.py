"""Entity assembly on hand-made quads."""

import pytest

from qaweave.operators import entities as E

S = "http://schema.org/"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def quads(spark, *triples, graph="g"):
    data = [("f", i, graph, s, p, o) for i, (s, p, o) in enumerate(triples)]
    return spark.createDataFrame(
        data, "file string, pos long, graph string, subject string, predicate string, object string")


def page(*subjects):
    return [("_:p", TYPE, S + "FAQPage")] + [("_:p", S + "mainEntity", s) for s in subjects]


def question(s, name, answer):
    return [(s, TYPE, S + "Question"), (s, S + "name", name), (s, S + "acceptedAnswer", answer)]


def answer(s, text):
    return [(s, TYPE, S + "Answer"), (s, S + "text", text)]


def joined(spark, triples, rows):
    e = E.build_entities(quads(spark, *triples))
    out = E.join_qa(E.questions_last_wins(E.questions(e)), E.page_main_entities(e), E.answers(e))
    return rows(out, "question", "answer")


def test_join(spark, rows):
    triples = page("_:q") + question("_:q", "Q1", "_:a") + answer("_:a", "A1")
    assert joined(spark, triples, rows) == [("Q1", "A1")]


def test_last_type_counts(spark, rows):
    e = E.build_entities(quads(
        spark, ("_:x", TYPE, S + "Answer"), ("_:x", S + "type", S + "Question"), ("_:x", S + "name", "n")))
    assert rows(e, "type", "value") == [(S + "Question", "n")]


@pytest.mark.parametrize("kind", ["http://schema.org/question", "http://schema.org/Thing"])
def test_other_types_are_dropped(spark, kind):
    assert E.build_entities(quads(spark, ("_:x", TYPE, kind), ("_:x", S + "name", "n"))).count() == 0


def test_untyped_is_dropped(spark):
    assert E.build_entities(quads(spark, ("_:x", S + "name", "n"))).count() == 0


def test_later_question_hides_earlier_even_outside_main(spark, rows):
    triples = (page("_:q1") + question("_:q1", "same", "_:a") + question("_:q2", "same", "_:a")
               + answer("_:a", "A"))
    assert joined(spark, triples, rows) == []
    triples = page("_:q2") + triples[2:]
    assert joined(spark, triples, rows) == [("same", "A")]


def test_property_spellings(spark, rows):
    """Values of the spelling first seen last; names compared without case."""
    triples = page("_:q") + [
        ("_:q", TYPE, "https://schema.org/Question"),
        ("_:q", "http://schema.org/name", "one"), ("_:q", "https://schema.org/NAME", "two"),
        ("_:q", "http://schema.org/name", "three"), ("_:q", S + "AcceptedAnswer", "_:a"),
        ("_:q", S + "AcceptedAnswer", "_:b"),
    ] + answer("_:a", "A") + answer("_:b", "B")
    assert joined(spark, triples, rows) == [("two", "A")]


def test_order_of_question_is_that_of_its_first_entity(spark, rows):
    triples = question("_:q1", "x", "_:a") + question("_:q2", "y", "_:a") + question("_:q3", "x", "_:a")
    e = E.build_entities(quads(spark, *triples))
    assert rows(E.questions_last_wins(E.questions(e)), "pos", "question", "subject") == [
        (0, "x", "_:q3"), (3, "y", "_:q2")]


def test_raw_objects_are_decoded(spark, rows):
    triples = [("_:q", TYPE, '"http://schema.org/Answer"'), ("_:q", S + "text", '"a &amp;amp; b"@en')]
    assert rows(E.build_entities(quads(spark, *triples), raw=True), "value") == [("a & b",)]
