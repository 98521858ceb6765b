"""The pipeline's stages, each on its own input."""

import collections
import random
import string
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from brightloom.llm import language, packing
from tests.llm.test_substrings import _each

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(cp.STAGES)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids(df):
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_are_as_contracted():
    assert [n for n, _ in cp.STAGES] == ["language ID", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]


def test_language_stage_keeps_what_is_like_a_language(spark, docs, sf_dir):
    odd = spark.createDataFrame([(-1, None, None, "s", 0), (-2, "123 --", "en", None, 6), (-3, "", "en", "s", 0), (None, "and the of words that", None, None, 21)], SCHEMA)
    rnd = random.Random(3)
    letters = " ".join("".join(rnd.choice(string.ascii_lowercase) for _ in range(rnd.randint(2, 9))) for _ in range(300))
    polish = "W wyniku tego posiedzenia postanowiono, że wszyscy uczestnicy będą zobowiązani do przestrzegania zasad, które zostały przyjęte w zeszłym roku przez zarząd spółki."
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."
    russian = "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему."
    foreign = spark.createDataFrame([(-10 - i, t, None, "s", len(t)) for i, t in enumerate((letters, polish, finnish, russian))], SCHEMA)
    out = STAGES["language ID"](spark, docs.unionByName(odd).unionByName(foreign), sf_dir)
    assert out.columns == COLUMNS and ids(out) == ids(docs) + collections.Counter([None])


def test_near_copies_leave_one(spark, docs, sf_dir):
    from tests.llm.test_jaccard import brute

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = STAGES["n-gram Jaccard join"](spark, docs, sf_dir)
    assert out.columns == COLUMNS and ids(out) == collections.Counter(d for d, _, c in brute(rows) if d == c)
    odd = spark.createDataFrame([(5, "a b", "en", "s", 3), (5, "a b", "en", "s", 3), (4, "A  b", "en", "s", 4), (6, None, None, None, None), (6, "", None, None, 0), (None, "c", None, None, 1), (None, "c", None, None, 1)], SCHEMA)
    assert ids(STAGES["n-gram Jaccard join"](spark, odd, sf_dir)) == collections.Counter({4: 1, 6: 2, None: 2})


def test_repeated_strings_are_cut(spark, docs, sf_dir):
    passage = "é" * 10 + " ".join(str(i) for i in range(300))
    odd = spark.createDataFrame([(-1, "start " + passage + " one", "en", "s", 1), (-2, "begin " + passage + " two", "en", "s", 1), (-3, passage, "en", "s", 1), (-4, None, None, None, None), (-5, "", "en", "s", 0)], SCHEMA)
    out = {r.doc_id: r for r in STAGES["suffix-array dedup"](spark, odd, sf_dir).collect()}
    assert (out[-1].text, out[-2].text, out[-4].text, out[-5].text) == ("startone", "begintwo", None, "") or (out[-1].text.split(), out[-2].text.split()) == (["start", "one"], ["begin", "two"])
    assert -3 not in out and out[-1].n_chars == len(out[-1].text) and out[-4].n_chars is None
    short = " ".join(f"word{i}" for i in range(51))
    two = spark.createDataFrame([(-1, "one side " + short + " x", "en", "s", 1), (-2, "another " + short, "en", "s", 1), (-3, "left alone " + short[:150], "en", "s", 1)], SCHEMA)
    out = {r.doc_id: r.text for r in STAGES["suffix-array dedup"](spark, two, sf_dir).collect()}
    assert out[-1].split() == ["one", "side", "x"] and out[-2].split() == ["another"] and out[-3] == "left alone " + short[:150]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = STAGES["suffix-array dedup"](spark, docs, sf_dir)
    own = spark.createDataFrame([(-1, short + " and " + short, "en", "s", 1), (-2, "left alone", "en", "s", 1)], SCHEMA)
    assert {r.doc_id: r.text for r in STAGES["suffix-array dedup"](spark, own, sf_dir).collect()} == {-1: short + " and " + short, -2: "left alone"}
    whole = {d: (n, gone) for d, n, gone, _, _ in _each(rows, cp.REPEATED, across=True)[0]}
    assert set(ids(kept)) == {d for d, (n, gone) in whole.items() if gone < n or not n}
    assert {r.doc_id for r in kept.join(docs.select("doc_id", F.col("text").alias("old")), "doc_id").filter("text <> old").collect()} == {d for d, (n, gone) in whole.items() if 0 < gone < n}
    assert kept.columns == COLUMNS and not ids(kept) - ids(docs)
    assert kept.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_benchmark_copies_go_and_the_rest_stays(spark, docs, sf_dir):
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    out = STAGES["benchmark decontamination"](spark, docs, sf_dir)
    gone = ids(docs) - ids(out)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {d for d, t in text.items() if any(i in t for i in items)} <= set(gone)
    assert out.columns == COLUMNS and len(gone) < 0.1 * len(text)


def test_any_column_names(spark, sf_dir):
    names = ["my col", "a-b", "a.b", "_", "row", "text ", "c"]
    docs = spark.createDataFrame([(i, f"the {x} of words that were written by somebody", "en", "s", 9, *names) for i, x in enumerate("abcdefg")], ["doc_id", "text", "lang", "source", "n_chars", *names])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() >= 1, name


def test_run(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    tables, pipelines = (list(Path(spark.conf.get("spark.checkpoint.dir")).glob(f"*/{x}")) for x in ("tables-*/*", "pipeline-*"))
    assert len(pipelines) == 1
    again = cp.run(spark, sf_dir)
    assert len(list(Path(spark.conf.get("spark.checkpoint.dir")).glob("*/tables-*/*"))) == len(tables) and again.count() == out.count()
    load = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert load and max(r.n for r in load) <= packing.CAPACITY


def test_empty_documents(spark, docs, sf_dir):
    none = docs.limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name
    assert language.UNKNOWN == "und"
