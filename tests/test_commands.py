"""The commands end to end on derived quad files."""

from pyspark.sql import functions as F

from qaweave.__main__ import Folder, _newest, main
from qaweave.registry import adapters

SF = "/root/testdata/sf0.001"


def test_extract_to_candidates(spark, tmp_path):
    root = str(tmp_path)
    lines = adapters.quad_lines(spark, SF)
    lines.repartition(3, "file").sortWithinPartitions("file", "pos").select("value").write.option(
        "compression", "gzip").text(f"{root}/downloads")
    spark.read.parquet(f"{SF}/documents.parquet").select("text", F.col("lang").alias("language")).write.parquet(f"{root}/known")
    main(["extract", root, "part-", f"{root}/known"])
    main(["merge", root])
    faq = spark.read.parquet(f"{root}/faq")
    assert faq.count() > 50 and faq.groupBy("language", "id").count().filter("count > 1").count() == 0
    for name in ("embed-text", "embed-qa", "embed-text"):
        main([name, root])
    assert spark.read.parquet(f"{root}/embeddings").count() == faq.count()
    main(["near-duplicates", root])
    assert spark.read.parquet(f"{root}/flags").count() == faq.count()
    for kind in ("topic", "question_type"):
        known = faq.select("language", F.monotonically_increasing_id().alias("pos"), "question", "answer",
                           (F.length("question") % 2 + 1).cast("int").alias("label"))
        known.write.partitionBy("language").parquet(f"{root}/annotations/{kind}")
        main(["train-labels", root, kind])
    assert spark.read.parquet(f"{root}/labels").count() == faq.count()
    for name in ("offsets", "statistics", "candidates", "score"):
        main([name, root])
    assert spark.read.text(f"{root}/statistics/statistics").count() == 1
    main(["annotate", root, "topic"])
    rows = faq.count()
    main(["merge", root, "--extend", "faq"])
    assert spark.read.parquet(f"{root}/faq").count() == rows


def test_retrieval_and_training(spark, tmp_path):
    from qaweave.registry.retrieval import _write_set

    root, sets = str(tmp_path / "data"), str(tmp_path / "sets")
    _write_set(spark, SF, "own", "eng", sets)
    seen = []
    for _ in range(2):
        for name in ("generate-jsonl", "evaluate", "sample"):
            main([name, root, sets, "own", "eng", *["--encoder", "qaweave.operators.embed:hashed_grams"] * (name == "evaluate")])
        seen.append([sorted(map(repr, spark.read.parquet(f"{root}/{t}").collect())) for t in ("results", "fine_tune")])
    assert seen[0] == seen[1] and all(seen[0])
    results = spark.read.parquet(f"{root}/results").collect()
    assert {r.language for r in results} == {"eng"} and len({r.model for r in results}) == 3
    assert all(0.0 <= r.value <= 1.0 for r in results)
    runs = spark.read.parquet(f"{root}/result_runs")
    assert runs.select("run").distinct().count() == 2 and runs.count() == 2 * len(results)
    # A run that began earlier and ends now changes nothing.
    runs.limit(1).select("task", "language", "model", "metric", "k", F.lit(0.5).alias("value"), F.lit("2000-01-01").alias("run")).write.mode(
        "append").parquet(f"{root}/result_runs")
    _newest(Folder(spark, root), "own", ["eng"])
    assert sorted(map(repr, spark.read.parquet(f"{root}/results").collect())) == seen[1][0]
    assert spark.read.text(f"{root}/bm25/own/eng", recursiveFileLookup=True).count() > 0
    main(["batches", root])
    assert spark.read.parquet(f"{root}/batches").count() % 128 == 0


def test_scores_to_bitexts(spark, tmp_path):
    from qaweave.registry.pairs import _scores

    root = str(tmp_path)
    _scores(spark, SF).drop("pos1", "pos2").write.json(f"{root}/scores")
    main(["assess", root])
    main(["transform", root])
