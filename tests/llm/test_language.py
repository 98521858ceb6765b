"""op1 against brute force, by held-out accuracy, and odd inputs."""

import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

from brightloom.llm import language


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language.op1_language_id(spark, sf_dir)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == docs.count()
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_labels_sources_and_ids_are_no_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language.learn(language.train_rows(docs))
    a = language.identify(docs, model).select("doc_id", "lang_pred", "score")
    b = language.identify(docs.withColumn("lang", F.lit("xx")).withColumn("other", -F.col("doc_id")), model).select("doc_id", "lang_pred", "score")
    assert sorted(a.collect()) == sorted(b.collect())


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "aaa bbb" if i % 2 else "ccc ddd", "x" if i % 2 else "y") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in language.train_rows(docs).collect()}
    import zlib

    assert kept == {i for i in range(60) if zlib.crc32(str(i).encode()) % 5}


def test_odd_texts(spark):
    train = spark.createDataFrame([(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(40)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    model = language.learn(language.train_rows(train))
    assert model.languages == ["de", "en"]
    texts = [(1, None), (2, ""), (3, "123 -- !!"), (4, "the dog " * 50_000), (None, "und die"), (None, "und die"), (5, "中文"), (6, "퟿ \U0001f600 a")]
    docs = spark.createDataFrame([(i, t, "en", 1.5) for i, t in texts], "doc_id long, text string, lang_pred string, score double")
    got = sorted(((r.doc_id, r.lang_pred, r.score > 0) for r in language.identify(docs, model).collect()), key=repr)
    want = [(1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (None, "de", True), (None, "de", True)]
    assert [g for g in got if g[0] not in (5, 6)] == sorted(want, key=repr)
    assert all(g[1] in ("de", "en") for g in got if g[0] in (5, 6))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.learn(language.train_rows(docs))
    assert language.identify(docs, model).count() == 0
    some = spark.createDataFrame([(1, "words", "en")], docs.schema)
    assert [(r.lang_pred, r.score) for r in language.identify(some, model).collect()] == [("und", 0.0)]


def brute_ngrams(text):
    """N-grams of one to three letters by their counts, borders as NUL."""
    t = ["\0", *(c if c.isalpha() else "\0" for c in text.lower()), "\0"]
    out = collections.Counter()
    for a, b, d in zip(t, t[1:], t[2:], strict=False):
        if b != "\0":
            out[b] += 1
            out[a + b + d] += 1
        if b != "\0" or a != "\0":
            out[a + b] += 1
    return out


def named(code):
    size, code = (3, code) if code >= 0 else (2, code + (1 << 62)) if code >= -(1 << 62) else (1, code + (1 << 63))
    return "".join(chr(code >> 21 * i & (1 << 21) - 1) for i in reversed(range(size)))


def in_order(counts):
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_ngrams_of_any_script(monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK", block)
    rnd = random.Random(1)
    for n in (1, 2, 5, 50, 3000):
        text = "".join(rnd.choice("abc é漢字\U00010400 .Жд") for _ in range(n))
        found, counts = language.ngrams(language.letters(text))
        assert {named(int(c)): int(k) for c, k in zip(found, counts, strict=True)} == brute_ngrams(text)


def test_whole_operator_equals_brute_force(spark):
    rnd = random.Random(2)
    kinds = {"en": "the of and to in that", "ru": "и в не на я быть", "zh": "的 一 是 不 了 人", "ja": "の に は を た が", "ko": "이 그 저 것 수 등"}
    rows = []
    for i in range(200):
        lang = rnd.choice(list(kinds))
        rows.append((i, " ".join("".join(rnd.choice(kinds[lang].split()) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randrange(60))) or None, rnd.choice([lang, lang, lang, None])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = collections.defaultdict(collections.Counter)
    for i, t, lang in rows:
        if lang and t and zlib.crc32(str(i).encode()) % 5:
            counts[lang].update(brute_ngrams(t))
    profiles = {lang: {g: k for k, g in enumerate(in_order(c)[:300])} for lang, c in counts.items()}

    def predict(text):
        top = in_order(brute_ngrams(text or ""))[:300]
        if not top:
            return "und", 0.0
        far = {lang: sum(min(300, abs(p[g] - k)) if g in p else 300 for k, g in enumerate(top)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        return best, 1 - far[best] / (300 * len(top))

    model = language.learn(language.train_rows(docs))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    assert got == {i: predict(t) for i, t, _ in rows}
    assert all(got[i][0] == lang for i, t, lang in rows if lang and t and len(t) > 20)


def test_any_column_names(spark):
    names = ["my col", "a-b", "a.b", "_", "row", "text ", "c"]
    docs = spark.createDataFrame([(1, "the words", "en", *names)], ["doc_id", "text", "lang", *names])
    out = language.identify(docs, language.learn(language.train_rows(docs))).collect()
    assert tuple(out[0])[: 3 + len(names)] == (1, "the words", "en", *names)


def test_out_of_place_distance():
    code = {g: int(c) for c in language.ngrams(language.letters("b"))[0] for g in [named(int(c))]}
    a = int(language.ngrams(language.letters("a"))[0][0])
    model = language.Model(["x", "y"], [[a, code["b"], code["\0b"]], [code["\0b"], a]])
    scorer = language.Scorer(model, 3)
    # of "b" alone the n-grams are "b", "_b" and "_b_"
    assert scorer.predict("b") == ("x", 1 - (1 + 1 + 3) / 9)


def test_every_labelled_text_teaches(spark):
    rows = [(i, c, "x") for j, c in enumerate("bcdefghijklmnopqrstu") for i in range(300 + j)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [g for g in map(named, model.profiles[0]) if len(g) == 1] == list("utsrqponmlkjihgfedcb")


@pytest.mark.parametrize("cells", [2, 1024])
def test_quantile_of_all_values(spark, monkeypatch, cells):
    import numpy as np

    monkeypatch.setattr(language, "CELLS", cells)
    rnd = random.Random(4)
    for values in ([], [0.3], [0.5] * 9, [rnd.choice([0.1, 0.2, rnd.random()]) for _ in range(300)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "score double")
        for share in (0.0, 0.01, 0.4, 1.0):
            want = pytest.approx(np.quantile(values, share), abs=1e-12) if values else None
            assert language.quantile(df, share) == want
