"""op4 against a heap, op9 against the tokenizer and a lower bound."""

import collections
import heapq
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brightloom.llm import packing, sharding


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 120), max_size=8), st.integers(1, 5))
def test_dealing_equals_the_heap(histogram, n):
    heap = [(0, s) for s in range(n)]
    want = collections.Counter()
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            want[size, s] += 1
    got = sharding.deal(list(histogram.items()), n)
    assert {(z, s): k for z, given_ in got.items() for s, k in enumerate(given_) if k} == dict(want)


def check_shards(rows, out, n):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out if r.doc_id is not None) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows if d is not None)
    assert len(out) == len(rows)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(n))


def test_shards(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = sharding.op4_lpt_sharding(spark, sf_dir).collect()
    check_shards(rows, out, 8)
    text, home, load = dict(rows), {}, collections.Counter()
    for r in out:
        assert home.setdefault(text[r.doc_id], r.shard) == r.shard
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= max(len((t or "").encode()) + 1 for _, t in rows)


def test_shards_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 2)
    rows = [(None, None), (None, None), (1, ""), (1, ""), (2, "x" * 100_000), *((i, "copy") for i in range(3, 90)), *((i, f"t{i}") for i in range(90, 130))]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, shard int")
    out = sharding.shard_documents(docs, 3).collect()
    check_shards(rows, out, 3)
    assert len({r.shard for r in out if r.size == 5 and r.doc_id is not None and 3 <= r.doc_id < 90}) == 1
    assert sharding.shard_documents(docs.limit(0), 3).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit(sizes):
    bins = packing.best_fit(sizes, 20)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 20 for b in bins)
    open_ = []  # best-fit decreasing, the slow way
    for size in sorted(sizes, reverse=True):
        fits = [x for x in open_ if x + size <= 20]
        if fits:
            open_.remove(max(fits))
        open_.append((max(fits) if fits else 0) + size)
    assert sorted(sum(sizes[i] for i in b) for b in bins) == sorted(open_)


def check_sequences(out):
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(by)


def test_pieces_and_sequences(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want, total = {}, 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[r.doc_id, p] = (at, len(part), zlib.crc32(part.tobytes()))
    out = packing.op9_best_fit_packing(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)
    assert check_sequences(out) <= -(-total // 2048) + 1


def test_tree_merge_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 20)
    rnd = random.Random(1)
    sizes = [rnd.choice([1, 700, 1100, 2048, rnd.randrange(1, 2049)]) for _ in range(400)]
    pieces = spark.createDataFrame([(None if i % 50 == 0 else i, 0, 0, s, 7) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(pieces).collect()
    assert sorted(r.length for r in out) == sorted(sizes)
    assert check_sequences(out) <= 1.1 * len(packing.best_fit(sizes, 2048))
    assert packing.pack(pieces.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_ids_equal_the_tokenizers(seed):
    from tokenizers import Tokenizer

    words, tokenizer = packing.word_ids(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    rnd = random.Random(seed)
    odd = ["It's 3½ a--b !!'s I'LL \x1c\x1d x\xa0y\x85z ſK \x00", "naïve 日本 ΑΣ İI", "<|endoftext|>", ""]
    odd += ["".join(chr(rnd.choice([rnd.randrange(0x180), rnd.randrange(128), 39, 32])) for _ in range(rnd.randrange(60))) for _ in range(400)]
    for t in odd:
        assert np.frombuffer(words.of(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_odd_documents(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 5), (2, "word " * 5000, 5), (2, "word " * 5000, 5)], "doc_id long, text string, piece long")
    out = packing.pack_documents(docs).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length) for r in out) == [(0, 0, 0, 1), (1, 0, 0, 1), *sorted([(2, 0, 0, 2048), (2, 1, 2048, 2048), (2, 2, 4096, 905)] * 2)]
    ids = packing.tokenize(docs, packing.tokenizer_path(), with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in ids)
