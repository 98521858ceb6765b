"""The pipeline as a whole against five brute-force stages, each fed by the one before."""

import collections
import zlib

import numpy as np

import corpus_pipeline as cp
from brightloom.llm import decontaminate, packing
from tests.llm.test_decontaminate import infix_distances
from tests.llm.test_jaccard import brute as near_copies
from tests.llm.test_language import brute_ngrams, in_order


def in_known_languages(rows):
    """rows: (doc_id, text, lang)."""
    counts = collections.defaultdict(collections.Counter)
    learned = [(t, lang) for d, t, lang in rows if lang and t is not None and zlib.crc32(str(d).encode()) % 5]
    for t, lang in learned:
        counts[lang].update(brute_ngrams(t))
    profiles = {lang: {g: k for k, g in enumerate(in_order(c)[:300])} for lang, c in counts.items()}

    def score(text):
        top = in_order(brute_ngrams(text or ""))[:300]
        return top and 1 - min(sum(min(300, abs(p[g] - k)) if g in p else 300 for k, g in enumerate(top)) for p in profiles.values()) / (300 * len(top))

    least = cp.LEAST_SHARE * np.quantile([s for s in (score(t) for t, _ in learned) if s], cp.RARE)
    return [(d, t) for d, t, _ in rows if (s := score(t)) and s >= least]


def without_repeats(rows):
    count, out = collections.Counter(), []
    strings = lambda b: {b[i : i + cp.REPEATED] for i in range(len(b) - cp.REPEATED + 1)}
    for _, t in rows:
        count.update(strings(t.encode()))
    for d, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - cp.REPEATED + 1):
            if count[b[i : i + cp.REPEATED]] > 1:
                gone[i : i + cp.REPEATED] = b"\1" * cp.REPEATED
        if not b or not all(gone):
            out.append((d, bytes(x for x, y in zip(b, gone, strict=True) if not y).decode("utf-8", "ignore") if any(gone) else t))
    return out


def without_benchmark(rows, items):
    grams = lambda b: {b[i : i + decontaminate.Q] for i in range(len(b) - decontaminate.Q + 1)}
    known = []
    for item in items:
        data = decontaminate.normal(item)[0].strip()
        assert len(data) >= decontaminate.SEGMENT, "a test for longer items"
        known.append((grams(data), [data[i : i + decontaminate.SEGMENT] for i in range(len(data) - decontaminate.SEGMENT + 1)]))
    out = []
    for d, t in rows:
        data = decontaminate.normal(t)[0]
        mine = grams(data)
        # a copy within the budget has a q-gram of the segment
        if not any((infix_distances(s, data) <= decontaminate.budget(decontaminate.SEGMENT)).any() for g, s in known if g & mine and len(g & mine) >= decontaminate.bound(decontaminate.SEGMENT)):
            out.append((d, t))
    return out


def test_run_equals_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = in_known_languages([(r.doc_id, r.text, r.lang) for r in docs])
    alone = {d for d, n, c in near_copies(rows) if d == c or not n}
    rows = [(d, t) for d, t in rows if d in alone]
    cut = without_repeats(rows)
    clean = without_benchmark(cut, items)
    assert len(docs) > len(rows) > 0 and dict(cut) != dict(rows) and len(clean) < len(cut)
    tokenizer, want = Tokenizer.from_file(packing.tokenizer_path()), set()
    for d, t in clean:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want |= {(d, p, at, len(x), zlib.crc32(x.tobytes())) for p, at in enumerate(range(0, len(ids), packing.CAPACITY)) for x in [ids[at : at + packing.CAPACITY]]}
    out = cp.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)
