"""op8 and op10 against brute force on whole texts."""

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brightloom.llm import automata, passages, suffix_array
from brightloom.llm.passages import NO_ID


def brute_words(rows, span):
    least = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - span + 1):
            x = tuple(w[i : i + span])
            least[x] = min(least.get(x, NO_ID), NO_ID if d is None else d)
    out = collections.Counter()
    for d, t in rows:
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        for i in range(len(w) - span + 1):
            if least[tuple(w[i : i + span])] < (NO_ID if d is None else d):
                gone[i : i + span] = b"\1" * span
        kept = b" ".join(x for x, y in zip(w, gone, strict=True) if not y)
        out[d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def corpus(seed):
    """Copies, near copies, shared passages, periodic and long texts, nulls, ties."""
    rnd = random.Random(seed)
    words = ["a", "bb", "ccc", "é", "the", "of"]
    base = [" ".join(rnd.choice(words) + (str(rnd.randrange(40)) if rnd.random() < 0.5 else "") for _ in range(rnd.randrange(160))) for _ in range(30)]
    rows = [(1, "w " * 3000), (None, None), (None, ""), (7, base[0]), (7, base[0])]
    for _ in range(110):
        t, kind = rnd.choice(base), rnd.random()
        if kind < 0.3:
            t = t[: rnd.randrange(len(t) + 1)] + rnd.choice(base)
        elif kind < 0.4:
            t = "x" * rnd.randrange(300)
        elif kind < 0.5:
            t = None
        elif kind < 0.6:
            t = t + " \t" + t
        elif kind < 0.7:
            t = "ab " * rnd.randrange(100)
        rows.append((rnd.choice([None, rnd.randrange(100), rnd.randrange(1000)]), t))
    return rows


def brute_shorter(rows, span, shorter):
    """``brute_bytes``, and how much the shorter span would take."""
    less = {(d, n, h): gone for (d, n, gone, _, _), h in zip(*_each(rows, shorter), strict=True)}
    return collections.Counter((*x, less[x[0], x[1], h]) for x, h in zip(*_each(rows, span), strict=True))


def _each(rows, span, across=False):
    """The brute-force row of each row, and its text."""
    count, out = collections.Counter(), []
    for _, t in rows:
        b = (t or "").encode()
        strings = (b[i : i + span] for i in range(len(b) - span + 1))
        count.update(set(strings) if across else strings)
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if count[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out, [t for _, t in rows]


def brute_bytes(rows, span, across=False):
    return collections.Counter(_each(rows, span, across)[0])


@pytest.mark.parametrize("bucket", [1024, 2])
def test_both_removals_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(passages, "BUCKET", bucket)
    if bucket == 2:
        monkeypatch.setattr(suffix_array, "_CELL", 3)
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for span in (40, 101):
        got = collections.Counter((r.row.doc_id, r.n_units, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.remove_repeats(docs, span).collect())
        assert got == brute_bytes(rows, span)
        got = collections.Counter((r.row.doc_id, r.n_units, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.remove_repeats(docs, span, across=True).collect())
        assert got == brute_bytes(rows, span, across=True) != brute_bytes(rows, span)
    for span, shorter in ((101, 60), (68, 34), (120, 64)):
        got = collections.Counter((r.row.doc_id, r.n_units, r.n_removed, r.n_spans, r.kept_sha256, r.n_shorter) for r in suffix_array.remove_repeats(docs, span, shorter=shorter).collect())
        assert got == brute_shorter(rows, span, shorter)
    for span in (10, 17):
        got = collections.Counter((r.row.doc_id, r.n_units, r.n_removed, r.kept_sha256) for r in automata.remove_repeats(docs, span).collect())
        assert got == brute_words(rows, span)


@pytest.mark.parametrize("size", [1 << 20, 900])
def test_known_texts_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(automata, "REFERENCE_BYTES", size)
    rows, span = corpus(7), 10
    known = [t for _, t in rows[::6]] + [None, ""]
    docs, references = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in known], "text string")
    windows = {tuple(w[i : i + span]) for t in known for w in [(t or "").encode().split()] for i in range(len(w) - span + 1)}
    want = collections.Counter()
    for d, t in rows:
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        for i in range(len(w) - span + 1):
            if tuple(w[i : i + span]) in windows:
                gone[i : i + span] = b"\1" * span
        want[d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, y in zip(w, gone, strict=True) if not y)).hexdigest()] += 1
    got = collections.Counter((r.row.doc_id, r.n_units, r.n_removed, r.kept_sha256) for r in automata.remove_known(docs, references, span).collect())
    assert got == want and sum(x[2] > 0 for x in want) > 20
    none = automata.remove_known(docs, references.limit(0), span)
    assert none.count() == len(rows) and none.filter("n_removed > 0").count() == 0 and automata.remove_known(docs.limit(0), references, span).count() == 0


def test_any_column_names(spark):
    names = ["my col", "a-b", "a.b", "_", "row", "text ", "c`d", "doc"]
    docs = spark.createDataFrame([(1, "x y", *names), (2, None, *names)], ["doc_id", "text", *names])
    for module in (automata, suffix_array):
        out = module.remove_repeats(docs).collect()
        assert {tuple(r.row) for r in out} == {(1, "x y", *names), (2, None, *names)}


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, d1 string, n_removed string, row string"
    for module in (automata, suffix_array):
        assert module.remove_repeats(spark.createDataFrame([], schema)).count() == 0
        out = module.remove_repeats(spark.createDataFrame([(1, "x y", "p", "q", "r"), (2, "x y", "p", "q", None)], schema)).collect()
        assert {(r.row.doc_id, r.row.d1, r.row.n_removed, r.row.row, r.kept) for r in out} == {(1, "p", "q", "r", "x y"), (2, "p", "q", None, "x y")}


def test_queries_on_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert collections.Counter(map(tuple, suffix_array.op10_suffix_array_dedup(spark, sf_dir).collect())) == brute_shorter(rows, 400, 200)
    assert collections.Counter(map(tuple, automata.op8_substring_dedup(spark, sf_dir).collect())) == brute_words(rows, 50)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=90).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6), st.sampled_from([16, 24, 40, 41]))
def test_bucket_pointer_refinement(texts, span):
    count = collections.Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    for t, twice in zip(texts, suffix_array.repeated(texts, span), strict=True):
        assert twice.tolist() == [count[t[i : i + span]] > 1 for i in range(len(t) - span + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b"]), max_size=25), st.integers(0, 9)), min_size=1, max_size=5), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=25), st.integers(2, 6))
def test_matching_statistics(references, query, span):
    automaton = automata.Automaton()
    for words, doc in references:
        automaton.add(words, doc)
    automaton.close()
    for words in [query, *(w for w, _ in references)]:
        got = automaton.statistics(words, span)
        for i in range(len(words) - span + 1):
            ids = [d for w, d in references for j in range(len(w) - span + 1) if w[j : j + span] == words[i : i + span]]
            assert got[i] == (min(ids) if ids else None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120), st.integers(2, 30), st.integers(0, 60))
def test_every_window_has_its_rightmost_smallest_gram(values, span, cutoff):
    q = 1
    grams = np.array(values, np.uint64) << np.uint64(40)
    n, k = len(values), min(cutoff, len(values))
    ends = np.array([k] * k + [n] * (n - k))
    places, lo, hi = passages.window_anchors(grams, ends, span, q)
    chosen = {s: p for p, a, b in zip(places.tolist(), lo.tolist(), hi.tolist(), strict=True) for s in range(a, b + 1)}
    want = {s: max(range(s, s + span), key=lambda i: (-values[i], i)) for s in range(n) if s + span <= ends[s]}
    assert chosen == want


def test_long_texts_of_one_unit(spark):
    unit = "".join(chr(97 + i * i % 23) for i in range(37)) + " "
    texts = {1: "a" * 30_000, 2: "a" * 399, 3: unit * 900, 4: unit * 5 + "é", 5: "w " * 20_000, 6: "w " * 49 + "v", 7: "w " * 60}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.row.doc_id: (r.n_units, r.n_removed, r.n_spans) for r in suffix_array.remove_repeats(docs, 400, shorter=200, with_kept=False).collect()}
    size = {d: len(t.encode()) for d, t in texts.items()}
    assert got == {d: (n, n, 1) if d in (1, 3, 5) else (n, 0, 0) for d, n in size.items()}
    got = {r.row.doc_id: (r.n_units, r.n_removed) for r in automata.remove_repeats(docs, 50, with_kept=False).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (900, 0), 4: (6, 0), 5: (20_000, 0), 6: (50, 0), 7: (60, 60)}


def test_known_texts_of_any_column_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "x")], ["doc_id", "a.b"])
    out = automata.remove_known(docs, docs.filter("doc_id = 1"), 10, text="a.b").collect()
    assert {r.row.doc_id: r.n_removed for r in out} == {1: 12, 2: 0}
