"""Stages held against what they promise, and the registered queries against their SQL."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import TABLES, rows_of
from qaweave.llm import mixing, quality
from tests.llm.conftest import ODD
from tests.llm.test_pairs_lines_passages import line_rule, union
from tests.llm.test_similar import jaccard, shingle_set

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"]


def test_names():
    assert sorted(NAMES, key=lambda n: int(n[2:].split("_")[0]) if n != "pipeline" else 0) == [
        "pipeline", "op1_exact_dedup", "op2_mix_sources", "op3_simhash", "op4_substring_dedup", "op5_line_dedup", "op6_pack",
        "op7_secrets", "op8_toxicity", "op9_quality", "op10_shard", "op11_prefix_trie", "op12_lexical_search", "op13_lattice_lm"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    assert got[1]
    if name in entry.oracle_sql():
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        rel = con.execute(entry.oracle_sql()[name])
        assert got == rows_of([d[0] for d in rel.description], rel.fetchall())


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet").cache(), []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        out.append((docs, after))
        docs = after
    return out


def test_quality_stage(stages):
    docs, after = stages[0]
    kept = {r.doc_id for r in quality.quality(docs).filter("kept").collect()}
    assert {r.doc_id: tuple(r) for r in after.collect()} == {r.doc_id: tuple(r) for r in docs.collect() if r.doc_id in kept}


def test_line_stage(stages):
    docs, after = stages[1]
    rows = docs.collect()
    want = line_rule([(r.doc_id, r.text) for r in rows])
    want = {r.doc_id: want[r.doc_id, r.text] for r in rows}
    assert {r.doc_id: r.text for r in after.collect()} == {i: t for i, t in want.items() if t.split()}
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_stage(stages):
    docs, after = stages[2]
    rows = docs.collect()
    sets = [shingle_set(r.text) for r in rows]
    root = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    groups = defaultdict(list)
    for r, g in zip(rows, root):
        groups[g].append(r.doc_id)
    assert {r.doc_id for r in after.collect()} == {min(g) for g in groups.values()}


def test_mixing_stage(stages):
    docs, after = stages[3]
    times = {r.doc_id: r.times for r in mixing.mix(docs).collect() if r.times}
    assert Counter(r.doc_id for r in after.collect()) == Counter(times)


def test_packing_stage(stages):
    docs, after = stages[4]
    rows = after.collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in docs.collect())
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048
    assert len(used) <= -(-sum(used.values()) // 2048) + 1


def test_stages_of_odd_rows(spark, table, empty):
    # Few rows pass the base rules of the first stage, so the others get all of them too.
    for rows in (table(ODD), empty):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, SF)
            assert after.columns == docs.columns
            docs = stage(spark, rows, SF)
        assert corpus_pipeline.packing_stage(spark, docs, SF).count() >= 0
        if rows is empty:
            assert docs.count() == 0


def test_a_group_keeps_one_row(spark, table):
    rng = np.random.default_rng(2)
    text = " ".join(f"y{v}" for v in rng.integers(0, 900, 80))
    rows = [(4, text, "en", "a"), (3, text, "en", "b"), (3, text, "en", "b"), (None, text + " z", "en", "a"), (7, "other words here in a row", "en", "a")]
    got = [r.doc_id for r in corpus_pipeline.near_stage(spark, table(rows), SF).collect()]
    assert sorted(got) == [3, 7]


def test_rows_alike_in_id_and_text(spark, table):
    """Which of them stays does not depend on their order or partitions."""
    rows = [(3, "some words that stand here in a row for all to see", "en", s) for s in "dcab"]
    kept = [{r.source for r in corpus_pipeline.near_stage(spark, table(x).repartition(n), SF).collect()} for n, x in ((1, rows), (3, rows[::-1]), (4, rows[2:] + rows[:2]))]
    assert len(kept[0]) == 1 and kept[0] == kept[1] == kept[2]
