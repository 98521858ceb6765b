"""op11 against brute force over all entries."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hn

from brightloom.llm import vector_codes as vc


def brute(parts, entries):
    far = ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    return far.argmin(1), far.min(1)


@settings(max_examples=300, deadline=None)
@given(st.data(), st.integers(1, 9), st.integers(1, 4), st.sampled_from([2, 30, 2**27]))
def test_nearest_equals_brute_force(data, k, d, most):
    numbers = st.integers(-most, most)
    entries, parts = data.draw(hn.arrays(np.int64, (k, d), elements=numbers)), data.draw(hn.arrays(np.int64, (12, d), elements=numbers))
    best, far, _ = vc.Annuli(entries).nearest(parts)
    want = brute(parts, entries)
    assert best.tolist() == want[0].tolist() and far.tolist() == want[1].tolist()


def test_an_annulus_leaves_most_entries_out():
    rnd = np.random.default_rng(1)
    entries, parts = (rnd.normal(0, 40, (n, 4)).astype(np.int64) for n in (256, 20_000))
    best, far, looked = vc.Annuli(entries).nearest(parts)
    assert (best == brute(parts, entries)[0]).all()
    assert looked < 0.55 * len(parts) * len(entries)


def by_hand(rows, parts, entries, rounds):
    """rows: (id, label, vector); the contract in plain Python."""
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda v: [tuple(v[p * len(v) // parts : (p + 1) * len(v) // parts]) for p in range(parts)]
    books = [list(b) for b in zip(*(cut(v) for _, _, v in sorted(kept, key=lambda r: r[0])[:entries]), strict=True)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda v: [min(range(len(b)), key=lambda i: (far(x, b[i]), i)) for x, b in zip(cut(v), books, strict=True)]
    for _ in range(rounds):
        codes = [assign(v) for _, _, v in kept]
        for p, book in enumerate(books):
            members = [[cut(v)[p] for (_, _, v), c in zip(kept, codes, strict=True) if c[p] == i] for i in range(len(book))]
            books[p] = [tuple(sum(x) // len(m) for x in zip(*m, strict=True)) if m else old for m, old in zip(members, book, strict=True)]
    out = {}
    for i, _, v in kept:
        code = assign(v)
        out[i] = ("".join(f"{c:02x}" for c in code), sum(far(x, b[c]) for x, b, c in zip(cut(v), books, code, strict=True)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_query_against_plain_python(spark, tmp_path):
    rnd = np.random.default_rng(2)
    rows = [(i, [None, 1, 2][i % 3], rnd.normal(0, 0.3, 32).round(3).tolist()) for i in range(150)]
    rows += [(150, 1, None), (151, 1, [0.0] * 31 + [None]), (152, 2, [float("nan")] + [0.0] * 31), (153, None, [float("-inf")] + [0.0] * 31), (-4, None, [-0.001] * 32), (-5, 1, [-0.001] * 32)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = vc.op11_vector_codes(spark, str(tmp_path)).collect()
    want, sha = by_hand(rows, 16, 64, 2)
    assert {r.vec_id: (r.code, r.error) for r in out} == want and {r.codebooks_sha256 for r in out} == {sha}
    label = {i: x for i, x, _ in rows}
    assert all(r.label_error == sum(e for i, (_, e) in want.items() if label[i] == label[r.vec_id]) for r in out)


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, x int, code string, `a.b` int"
    rows = [(None, [0.5, 0.25], 1, "k", 2), (1, [0.5, 0.25], 1, "k", 2), (1, [0.5, 0.25], 1, "k", 2), (2, [1.0], 1, None, 2), (3, [], 1, "k", 2), (0, [3e38, -3e38], None, "k", 2)]
    codes, books = vc.compress(spark.createDataFrame(rows, schema), parts=2, entries=2)
    out = codes.collect()
    assert sorted((r.row.vec_id if r.row.vec_id is not None else 9, r.code, r.error) for r in out) == [(0, b"\0\0", 0), (1, b"\1\1", 0), (1, b"\1\1", 0), (9, b"\1\1", 0)]
    assert books[0][0, 0] == vc.limit(2) and vc.decoded(out[0].code, books).tolist() in ([128, 64], [vc.limit(2), -vc.limit(2)])
    assert vc.compress(spark.createDataFrame(rows, schema).limit(0)).codes.count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vc.compress(spark.createDataFrame(rows[:2], schema), parts=3)
