"""Files in and out."""

import gzip

import pytest
from pyspark.sql import functions as F

from qaweave import schemas
from qaweave.plans.extract import extract_faq
from qaweave.session import shared_folder, stored
from qaweave.sources import lines as L
from qaweave.sources import retrieval_sets as S
from qaweave.sources.entity_store import checkpoint_entities, finished_files

TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


def quad_file(n):
    g = f"<https://h{n}.example/faq>   ."
    return "\n".join([
        f"_:p {TYPE} <http://schema.org/FAQPage> {g}", f"_:p <http://schema.org/mainEntity> _:q {g}",
        f"_:q {TYPE} <http://schema.org/Question> {g}", f'_:q <http://schema.org/name> "Q: How long does it take?"@en {g}',
        f"_:q <http://schema.org/acceptedAnswer> _:a {g}", f"_:a {TYPE} <http://schema.org/Answer> {g}",
        f'_:a <http://schema.org/text> "<p>It takes about two &amp;amp; a half days in most places.</p>" {g}', "broken line",
    ]) + "\n"


def write_gz(path, text):
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write(text)


def test_quads_to_faq(spark, tmp_path):
    for n in (1, 2):
        write_gz(tmp_path / f"faq-{n}.gz", quad_file(n))
    write_gz(tmp_path / "other-1.gz", quad_file(3))
    lines = L.read_quad_lines(spark, L.quad_files(spark, str(tmp_path), "faq-"))
    assert {r.file for r in lines.collect()} == {"faq-1", "faq-2"}
    firsts = lines.groupBy("file").agg(F.min_by("value", "pos").alias("v")).collect()
    assert all(r.v.startswith("_:p") for r in firsts)
    store = checkpoint_entities(spark, lines, str(tmp_path / "store"))
    detector = lambda df, column: df.withColumns({"label": F.lit("en"), "confidence": F.lit(0.9)})
    out = extract_faq(store, detector)
    got = sorted((r.file, r.scheme_host, r.language, r.question, r.answer) for r in out.collect())
    assert got == [
        (f"faq-{n}", f"https://h{n}.example", "eng", "How long does it take?",
         "It takes about two & a half days in most places.") for n in (1, 2)]
    assert len({r.id for r in out.collect()}) == 1  # equal text in two files is kept until the merge


def test_entities_are_stored_once_per_file(spark, tmp_path):
    write_gz(tmp_path / "a-1.gz", quad_file(1))
    path = str(tmp_path / "store")  # below the downloads: its folders are not read as input
    def run(properties=None):
        files = L.quad_files(spark, str(tmp_path), "a").join(finished_files(spark, path, properties), "file", "left_anti")
        names = sorted(r.file for r in files.collect())
        return names, checkpoint_entities(spark, L.read_quad_lines(spark, files), path, properties, files)

    names, store = run()
    assert names == ["a-1"] and store.count() == 4
    names, store = run()
    assert names == [] and store.count() == 4
    write_gz(tmp_path / "a-2.gz", quad_file(2))
    write_gz(tmp_path / "a-3.gz", "nothing of the form\n")
    write_gz(tmp_path / "a-4.gz", "")
    names, store = run()
    assert names == ["a-2", "a-3", "a-4"]
    assert {r.file for r in store.collect()} == {"a-1", "a-2"} and store.count() == 8
    names, store = run()
    assert names == [] and store.count() == 8, "files without entities are read once"
    names, store = run(("name",))
    assert len(names) == 4 and {r.predicate for r in store.collect()} == {"http://schema.org/name"}
    assert run()[1].count() == 8


def test_a_stopped_job_is_done_again(spark, tmp_path):
    """Entities without an entry in the manifest are parsed again and replaced."""
    path, lines = str(tmp_path / "store"), spark.createDataFrame(
        [("f", i, v) for i, v in enumerate(quad_file(1).splitlines())], "file string, pos long, value string")
    checkpoint_entities(spark, lines, path)
    import shutil
    shutil.rmtree(tmp_path / "store" / "all" / "finished")
    assert checkpoint_entities(spark, lines, path).count() == 4
    assert [r.file for r in finished_files(spark, path).collect()] == ["f"]
    assert checkpoint_entities(spark, lines.limit(0), path).count() == 4


def test_no_input_files(spark, tmp_path):
    files = L.quad_files(spark, str(tmp_path), "none-[x]")
    assert files.count() == 0 and L.read_quad_lines(spark, files).count() == 0
    assert L.quad_files(spark, str(tmp_path / "missing"), "a").count() == 0


def test_parts_take_the_place_of_the_file(spark, tmp_path):
    path = str(tmp_path / "parts")
    def rows(*data):
        return spark.createDataFrame(data, "language string, file string, id string")

    def written():
        return sorted((r.language or "-", r.file, r.id) for r in spark.read.schema("id string, language string, file string").parquet(path).collect())

    L.write_by_language(rows(("eng", "a-1", "x"), ("eng", "a-1", "y"), ("fra", "a-1", "u"), ("eng", "a+%:1", "s")), path, "parquet")
    L.write_by_language(rows(("eng", "b-1", "z"), (None, "b-1", "n")), path, "parquet")
    assert len(written()) == 6
    # A second detector finds other languages: the rows are there once.
    L.write_by_language(rows(("deu", "a-1", "x"), ("fra", "a-1", "y"), ("deu", "a+%:1", "s")), path, "parquet")
    assert written() == [("-", "b-1", "n"), ("deu", "a+%:1", "s"), ("deu", "a-1", "x"), ("eng", "b-1", "z"), ("fra", "a-1", "y")]
    # A file without rows loses its folders only if the run names it.
    L.write_by_language(rows(("eng", "c", "q")), path, "parquet", spark.createDataFrame([("a-1",), ("c",)], "file string"))
    assert written() == [("-", "b-1", "n"), ("deu", "a+%:1", "s"), ("eng", "b-1", "z"), ("eng", "c", "q")]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_tolerant_json(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text(
        '{"id": "1", "filter": true, "near_duplicate_similarity": 0.5}\n{"id": "2"\n\n{"id": "3"}\nno\n')
    good, bad = L.read_jsonl(spark, str(tmp_path / "x.jsonl"), schemas.FLAGS)
    assert {(r.id, r.filter) for r in good.collect()} == {("1", True), ("3", None)}
    assert {r.line for r in bad.collect()} == {'{"id": "2"', "no"}
    (tmp_path / "y.jsonl").write_text('{"id": "9"}\n')
    assert L.read_many(spark, str(tmp_path / "*.jsonl"), schemas.FLAGS).count() == 3


def test_merged_positions(spark, tmp_path):
    df = spark.createDataFrame([("e", "b"), ("e", "a"), ("f", "c")], "language string, url string").orderBy("language", "url")
    L.write_merged(df, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m")).orderBy("pos").collect()
    assert [r.url for r in back] == ["a", "b", "c"]


def test_bitexts_are_sorted(spark, tmp_path):
    data = [(f"p{i % 2}", f"u{9 - i}", "q", "r") for i in range(10)]
    df = spark.createDataFrame(data, "pair string, url string, question1 string, question2 string").withColumn(
        "details", F.struct(F.array("url", "url").alias("urls")))
    L.write_bitexts(df.drop("url"), str(tmp_path / "b"))
    for pair in ("p0", "p1"):
        files = sorted((tmp_path / "b" / f"pair={pair}").glob("*.json"))
        import json
        urls = [json.loads(line)["details"]["urls"][0] for f in files for line in f.read_text().splitlines()]
        assert urls == sorted(urls) and len(urls) == 5


def test_own_layout_keeps_last_judgement(spark, tmp_path):
    for name, text in {
        "eng-queries/queries.jsonl": '{"_id": "1", "text": "q1"}\n{"_id": "2", "text": "q2"}\n',
        "eng-corpus/corpus.jsonl": '{"_id": "a", "title": "t", "text": "x"}\n',
        "eng-qrels/test.jsonl": '{"query-id": 1, "corpus-id": "a", "score": 1}\n{"query-id": 1, "corpus-id": "b", "score": 2}\n',
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    q, c, r = S.load_retrieval_set(spark, str(tmp_path), "own", "eng")
    assert [tuple(x) for x in r.collect()] == [("1", "b", 2)]
    assert [tuple(x) for x in q.collect()] == [("1", "q1")] and c.count() == 1
    q, c, r = S.load_retrieval_set(spark, str(tmp_path), "passages", "eng")
    assert q.count() == 2 and r.count() == 2


def test_layout_of_pooled_set():
    assert S.layout_of("pooled", "eng").doc_id == "_id" and S.layout_of("pooled", "yor").doc_id == "docid"
    assert S.layout_of("named", "eng").split == "dev" and S.layout_of("own", "eng").split == "test"


def test_tsv_round_trip(spark, tmp_path):
    texts = ['tab\tquote " and\nline', "\\n is no break, \\\\n neither", "\r\n", "\\", "\\\n\\", '"', '"a"\n"b"', "x\ty", "plain"]
    queries = spark.createDataFrame([(f"00{i}", t) for i, t in enumerate(texts)], schemas.QUERIES).coalesce(1)
    corpus = spark.createDataFrame([("d", "t", "text")], schemas.CORPUS)
    qrels = spark.createDataFrame([("007", "0001", 1)], schemas.QRELS)
    S.write_retrieval_set(queries, corpus, qrels, str(tmp_path / "s"))
    q, r = S.read_retrieval_tsv(spark, str(tmp_path / "s"))
    assert [tuple(x) for x in q.collect()] == [(f"00{i}", t) for i, t in enumerate(texts)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        parts, _ = S.read_retrieval_tsv(spark, str(tmp_path / "s"))
        assert parts.select(F.spark_partition_id()).distinct().count() > 1, "one file, several tasks"
        assert {tuple(x) for x in parts.collect()} == {tuple(x) for x in q.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [tuple(x) for x in r.collect()] == [("007", "0001", 1)]
    assert spark.read.json(str(tmp_path / "s" / "corpus")).columns == ["contents", "id"]


def test_a_stored_result_leaves_no_shuffle_files(spark):
    import glob
    import time

    top = spark.sparkContext.getConf().get("spark.local.dir", "/tmp")
    files = lambda: set(glob.glob(f"{top}/blockmgr-*/**/shuffle_*.data", recursive=True))
    before = files()
    table = stored(spark.range(20_000).groupBy((F.col("id") % 500).alias("k")).count(), "counts")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and table.count() == 500
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
