"""op7 against all pairs."""

import random
import re

import pytest

from brightloom.llm import jaccard
from brightloom.llm.components import components

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, percent=75):
    sets = []
    for _, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate(_LOWER)) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), jaccard.NO_ID), jaccard.NO_ID if d is None else d)
    return sorted(((d, len(sets[i]), None if least[top(i)] == jaccard.NO_ID else least[top(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    rows = [(None, None), (None, ""), (None, "only words here"), (9001, "only Words here"), (9002, " \t"), (9003, "x"), (9004, "x y " * 4000)]
    for _ in range(22):
        base = [rnd.choice("abcdefghij") + str(rnd.randrange(30)) for _ in range(rnd.choice([3, 5, 8, 20, 60]))]
        for _ in range(rnd.randrange(1, 30)):
            w = list(base)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = rnd.choice("xyz")
            if rnd.random() < 0.2:
                w += ["common", "line", "of", "words", "in", "many", "texts"]
            rows.append((len(rows), " ".join(w) if rnd.random() < 0.9 else "\n".join(w).upper()))
    rows += rows[20:30]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("group", [64, 3])
def test_equals_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    rows = corpus(group)
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.row.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


def test_links_at_the_very_bound(spark):
    # sets of four words each: single shingles can't link unless equal; six of eight shingles do
    a = [f"w{i}" for i in range(11)]  # 7 shingles
    b = [*a, "z"]  # 8 shingles, 7 shared: 7/8
    c = [*a[:10], "q", "q2"]  # shares 6 with a: 6/9
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    got = {r.row.doc_id: r.component_id for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, node string, label string, component_id string"
    assert jaccard.join_components(spark.createDataFrame([], schema)).count() == 0
    out = jaccard.join_components(spark.createDataFrame([(2, "a b", "n", "l", "c"), (1, "A b", "n", "l", "c")], schema)).collect()
    assert {(r.row.doc_id, r.row.component_id, r.component_id) for r in out} == {(2, "c", 1), (1, "c", 1)}


def test_query_on_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, jaccard.op7_ngram_jaccard_join(spark, sf_dir).collect())) == sorted(brute(rows))


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(-40, 40), rnd.randrange(-40, 40)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e if x is not None and e[0] is not None and e[0] != e[1]}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: top(x) for x in up}


def test_hot_texts_send_one_row(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_ROWS", 5)
    rows = [*corpus(1), *((None, "a hot text of seven words here") for _ in range(20)), *((10_000 - i, "another hot text of eight words for all") for i in range(300)), *((7, "one id and text of its rows") for _ in range(30))]
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted(((r.row.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)
    assert jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).filter("text LIKE '%eight words%'").select("doc_id").collect() == [(9701,)]


def test_long_texts_of_one_unit(spark):
    rows = [(1, "a b c d e f g " * 60_000), (2, "A b c d e f g " * 30_000), (3, "a b c d e f g h " * 20_000), (4, "x " * 200_000), (5, "x " * 5), (6, "x" * 500_000)]
    got = {r.row.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (7, 1), 2: (7, 1), 3: (8, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6)}
