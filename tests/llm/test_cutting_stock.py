"""op13: the program against brute force over all patterns, and the packing against the tokenizer."""

import collections
import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brightloom.llm import cutting_stock as cs


def all_patterns(sizes, capacity):
    return [p for p in itertools.product(*(range(capacity // s + 1) for s in sizes)) if any(p) and sum(n * s for n, s in zip(p, sizes, strict=True)) <= capacity]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=4, unique=True), st.lists(st.floats(0, 1), min_size=4, max_size=4))
def test_knapsack_equals_all_patterns(sizes, prices):
    sizes, prices = sorted(sizes), prices[: len(sizes)]
    worth, counts = cs.knapsack(np.array(sizes), np.array(prices), 12)
    value = lambda p: sum(n * v for n, v in zip(p, prices, strict=True))
    assert worth == pytest.approx(max(map(value, all_patterns(sizes, 12))), abs=1e-9) == pytest.approx(value(counts.tolist()), abs=1e-9)
    assert sum(n * s for n, s in zip(counts.tolist(), sizes, strict=True)) <= 12


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 500), min_size=1, max_size=8))
def test_the_program_ends_at_its_optimum(histogram):
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in sizes.tolist()], float)
    columns, used, bound = cs.column_generation(sizes, demand, 16, near=1e-9)
    assert np.allclose(columns @ used, demand) and (used >= 0).all() and (sizes @ columns <= 16).all()
    assert used.sum() == pytest.approx(bound, rel=1e-6)  # primal equals dual: nothing is better


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 300), max_size=10))
def test_patterns_hold_every_item_once(histogram):
    found = cs.patterns(histogram, 20)
    have = collections.Counter()
    for p in found:
        assert sum(s * n for s, n in p.slots) <= 20
        for s, n in p.slots:
            have[s] += n * p.copies
    assert have == histogram
    places = cs.Places(found)
    assert places.sequences >= -(-sum(s * n for s, n in histogram.items()) // 20)
    seen = set()
    for s, n in histogram.items():
        sequence, slot = places.at(np.full(n, s), np.arange(n))
        seen |= set(zip(sequence.tolist(), slot.tolist(), strict=True))
    assert len(seen) == sum(histogram.values()) and {x for x, _ in seen} == set(range(places.sequences))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 63), st.integers(1, 50), max_size=10), st.integers(1, 9))
def test_what_is_dissolved_fills_the_rest(gaps, least):
    gap, n = cs.to_dissolve(gaps, 64, least)
    assert 0 <= n <= gaps.get(gap, 0)
    tokens = sum((64 - g) * k for g, k in gaps.items() if g > gap) + n * (64 - gap)
    assert tokens >= sum(g * k for g, k in gaps.items() if least <= g < gap) + gap * (gaps.get(gap, 0) - n) * (gap >= least)


def check(out, docs, capacity, end, least):
    """docs: (doc_id, ids with their end); rows of one document are told apart by their count only."""
    want = collections.Counter((d, ids.tobytes()) for d, ids in docs)
    have = collections.defaultdict(list)
    for r in out:
        have[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for (d, data), copies in want.items():
        mine = [x for x in have[d] if x[3] == len(data) // 4]
        assert sorted(i for start, n, *_ in mine for i in range(start, start + n)) == sorted(list(range(len(data) // 4)) * copies)
        assert all(zlib.crc32(data[4 * s : 4 * (s + n)]) == crc for s, n, crc, _ in mine)
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and (capacity - at < least or at & (at - 1) == 0)
    return len(by)


def ids_of(text, end):
    from tokenizers import Tokenizer

    from brightloom.llm.packing import tokenizer_path

    global _TOKENIZER
    _TOKENIZER = globals().get("_TOKENIZER") or Tokenizer.from_file(tokenizer_path())
    return np.array([*_TOKENIZER.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_pieces_and_sequences(spark, sf_dir):
    docs = [(r.doc_id, ids_of(r.text, 2)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = cs.op13_cutting_stock_packing(spark, sf_dir).collect()
    n = check(out, docs, 4096, 2, cs.LEAST)
    assert n <= -(-sum(len(x) for _, x in docs) // 4096) + 13
    cut_ = {r.doc_id for r in out if r.length < r.doc_tokens <= 4096}
    assert len(cut_) < 0.1 * len(docs)


def test_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(cs, "RUN", 2)
    texts = [(1, None), (None, ""), (None, "a b"), (2, "word " * 5000), (2, "word " * 5000), (3, "é <|endoftext|> x"), *((i, "w " * (i * 7 % 50)) for i in range(4, 90)), (90, "v " * 127), (91, "v " * 126)]
    docs = spark.createDataFrame([(d, t, 5, "x") for d, t in texts], "doc_id long, text string, start int, `a.b` string")
    out = cs.pack_documents(docs, capacity=128).collect()
    check(out, [(d, ids_of(t, 2)) for d, t in texts], 128, 2, cs.LEAST)
    check(cs.pack_documents(docs, capacity=90).collect(), [(d, ids_of(t, 2)) for d, t in texts], 90, 2, cs.LEAST)
    assert cs.pack_documents(docs.limit(0), capacity=128).count() == 0
    one = cs.pack_documents(docs.filter("doc_id = 1")).collect()
    assert [(r.start, r.length, r.doc_tokens, r.offset) for r in one] == [(0, 1, 1, 0)]
