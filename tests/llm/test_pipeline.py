"""The pipeline on a small corpus: each stage against what it should keep, and the queries' registration."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.test_operators import DOC, brute_components, prose


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        lang = ("en", "fr")[i % 2]
        t = prose(rng, 80, "etaoins" if lang == "en" else "éàucqvj")
        rows.append((i, t, lang, f"s{i % 4}"))
    rows += [(100 + i, rows[i][1] + " zz", rows[i][2], "s0") for i in range(10)]
    rows += [(200, "123 456 !!", "en", "s1"), (201, None, "en", "s1"), (202, "", None, None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOC).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        steps[name] = docs.collect()
        if name == "source_mix":
            steps["mixed"] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in rows} - {r.doc_id for r in steps["language_id"]} == {200, 201, 202}
    want = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in steps["language_id"]]) if i == c}
    assert {r.doc_id for r in steps["near_duplicates"]} == want and len(want) == 60
    assert {r.doc_id: r.text for r in steps["suffix_dedup"]} == {r.doc_id: r.text for r in steps["near_duplicates"]}
    times = Counter(r.doc_id for r in steps["source_mix"])
    assert set(times.values()) <= {1, 2} and 1.2 < sum(times.values()) / 60 < 1.8
    assert Counter(r.doc_id for r in steps["packing"] if r.piece == 0) == times
    # passes are told apart, and positions are places in the order that the mix made
    packed = [(r.position, r.doc_id) for r in steps["packing"] if r.piece == 0]
    assert len({p for p, _ in packed}) == len(packed)
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    mixed = steps["mixed"].select((part * (1 << 40) + F.col("_metadata.row_index")).alias("position"), "doc_id").collect()
    assert sorted(packed) == sorted(map(tuple, mixed))


@pytest.mark.parametrize("kind", ["several files a task", "other names"])
def test_positions_whatever_the_files_are_called(spark, tmp_path, kind):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, prose(rng, 8), "en", "s", 0) for i in range(60)], DOC).repartition(2)
    docs.write.option("maxRecordsPerFile", 7).parquet(f"{tmp_path}/d")
    if kind == "other names":
        for k, f in enumerate(sorted((tmp_path / "d").glob("*.parquet"))):
            f.rename(f.parent / f"docs_{k}.parquet")
        for f in (tmp_path / "d").glob(".*crc"):
            f.unlink()
    rows = corpus_pipeline.in_file_order(spark.read.parquet(f"{tmp_path}/d"), "p").collect()
    assert len({r.p for r in rows}) == len(rows) == 60
    packed = [r.position for r in corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/d"), "").collect()]
    assert sorted(packed) == sorted(r.p for r in rows)


def test_run_gives_the_same_pieces(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "length", "ids_crc32").collect()
    again = corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and got


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
