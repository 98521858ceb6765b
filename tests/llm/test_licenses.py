"""op3: base phrases against brute force, rules by example, suppression."""

import random
import re

import pytest

from brightloom.llm import licenses
from brightloom.llm.license_rules import Rule, rules

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = _WORD.findall((text or "").translate(_LOWER))
    hits = [(i, label) for i in range(len(w)) for phrase, label in licenses.BASE.items() if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def found(spark, texts):
    rows = licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    return {texts[r.doc_id]: r for r in rows}


def test_base_columns(spark, sf_dir):
    texts = [None, "", " -- ", "cc by", "CC-BY cc by", "All rights, reserved. all rights reserved", "small rights reserved all rights\nreserved", "ccé by cc by", "GNU General  Public\tLicense general public license", "İcc by Kcc by", "a " * 40_000 + "cc by " * 3]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").distinct().collect()]
    for t, r in found(spark, texts).items():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0 (the License)", "apache-2.0"),
        ("// SPDX-License-Identifier: MIT", "mit"),
        ("SPDX-License-Identifier: MIT-0", "mit-0"),
        ("This work is under CC BY-NC-SA 4.0.", "cc-by,cc-by-nc-sa-4.0"),
        ("under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("GNU Lesser General Public License version 2.1", "gpl,lgpl-2.1"),
        ("the new BSD license", "bsd-3-clause"),
        ("released into the public domain", "public-domain"),
        ("limit licensing committee", ""),
        ("Mit der Katze", ""),
    ],
)
def test_rules(spark, text, labels):
    assert found(spark, [text])[text].labels == labels


def test_suppression_and_priority(spark):
    own = [Rule(0, 2, "short", "b", "(?<= )(?:b c)(?= )"), Rule(1, 2, "long", "b", "(?<= )(?:a b c d)(?= )"), Rule(2, 1, "better", "b", "(?<= )(?:c d)(?= )"), Rule(3, 2, "tie", "b", "(?<= )(?:a b c d)(?= )"), Rule(4, 3, "cross", "b", "(?<= )(?:d e)(?= )")]
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "b c x"), (3, "b c a b c d b c")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs, found=own).collect()}
    assert got == {1: ("better,cross,long", 1.0), 2: ("short", 0.85), 3: ("better,long,short", 1.0)}


def test_rules_are_well_formed_and_gated():
    table = rules()
    assert len(table) > 200 and len({r.regex for r in table}) > 200
    some = licenses.gates(table)
    for r in table:
        re.compile(r.regex)
        assert r.priority in (1, 2, 3) and any(g in "licen" or g in r.keyword or r.keyword in g for g in some)


def test_odd_rows(spark):
    schema = "doc_id long, text string, labels string, `a.b` int"
    assert licenses.scan(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, "cc by", "mine", 1), (None, "cc by", "mine", 1), (2, None, None, None)], schema)
    out = licenses.scan(docs)
    assert [c for c in out.columns if c == "labels"] == ["labels"] and "a.b" in out.columns
    assert sorted((r.n_base, r.labels) for r in out.collect()) == [(0, ""), (1, "cc-by"), (1, "cc-by")]


def test_keywords_stand_in_all_spellings(spark):
    spellings = {"under the Open RAIL M license": "openrail", "under the OpenRAIL-M license": "openrail", "this End User Licence Agreement": "proprietary", "this End User License Agreement": "proprietary"}
    for text, label in spellings.items():
        plain = f" {re.sub('[^a-z]+', ' ', text.lower())} "
        assert any(r.label == label and r.keyword in plain and re.search(r.regex, plain) for r in rules()), text
    rows = found(spark, list(spellings))
    assert all(label in str(rows[text]) for text, label in spellings.items())


def spelled(parsed, rnd):
    """A random text that a regex matches."""
    out = ""
    for kind, x in parsed:
        name = str(kind)
        if name == "LITERAL":
            out += chr(x)
        elif name == "NOT_LITERAL":
            out += "w"
        elif name == "ANY":
            out += "w"
        elif name == "IN":
            out += "w" if str(x[0][0]) == "NEGATE" else rnd.choice([chr(v) if str(k) == "LITERAL" else chr(rnd.randint(*v)) for k, v in x])
        elif name == "SUBPATTERN":
            out += spelled(x[3], rnd)
        elif name == "BRANCH":
            out += spelled(rnd.choice(x[1]), rnd)
        elif name == "MAX_REPEAT":
            out += "".join(spelled(x[2], rnd) for _ in range(rnd.randint(x[0], min(int(x[1]), x[0] + 2))))
        else:
            assert name == "ASSERT", name
    return out


def spellings(rule, rnd, n):
    parsed = re._parser.parse(rule.regex.removeprefix("(?<= )(?:").removesuffix(")(?= )"))
    return [spelled(parsed, rnd) for _ in range(n)]


def test_a_rule_matches_only_where_its_keyword_stands():
    rnd = random.Random(11)
    for rule in rules():
        for text in spellings(rule, rnd, 40):
            text = re.sub("[^a-z0-9]+", " ", text).strip()
            if re.search(rule.regex, f" {text} "):
                assert rule.keyword in f" {text} " and any(g in f" {text} " for g in licenses.gates(rules())), (rule, text)


def brute_labels(text):
    """Every rule on the whole text; what another one contains that is no worse goes."""
    words = _WORD.findall((text or "").translate(_LOWER))
    plain = " " + " ".join(words) + " "
    hits = []
    for rule in rules():
        if rule.keyword in plain:
            hits += [(plain[: m.start()].count(" ") - 1, plain[: m.end()].count(" ") - 1, rule.priority, rule.id, rule.label) for m in re.finditer(rule.regex, plain)]
    hits.sort(key=lambda h: (h[0], -h[1], h[2], h[3]))
    kept = [h for i, h in enumerate(hits) if not any(e[1] >= h[1] and e[2] <= h[2] for e in hits[:i])]
    base = brute(text)[4]
    labels = {*filter(None, base.split(",")), *(h[4] for h in kept)}
    best = min((h[2] for h in kept), default=None)
    return ",".join(sorted(labels)), licenses.CONFIDENCE[best] if best else licenses.BASE_CONFIDENCE if base else 0.0


def test_method_labels_equal_brute_force(spark, sf_dir):
    rnd = random.Random(12)
    table = rules()
    texts = [t for rule in table for t in spellings(rule, rnd, 1)]
    for _ in range(300):
        parts = [spellings(rnd.choice(table), rnd, 1)[0] if rnd.random() < 0.7 else " ".join(rnd.choice(["the", "license", "of", "mit", "version", "2", "rights"]) for _ in range(4)) for _ in range(rnd.randint(2, 7))]
        texts.append(rnd.choice([" ", "\n", ", "]).join(x.title() if rnd.random() < 0.3 else x for x in parts))
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").distinct().collect()]
    texts = sorted(set(texts))
    rows = found(spark, texts)
    wrong = {t: ((r.labels, r.score), brute_labels(t)) for t, r in rows.items() if (r.labels, r.score) != brute_labels(t)}
    assert not wrong, next(iter(wrong.items()))
    assert len({x for r in rows.values() for x in r.labels.split(",")}) > 80


def test_time_grows_with_the_detections(spark):
    import time

    took, n = [], 10_000
    for _ in range(2):
        docs = spark.createDataFrame([(1, "mit license " * n)], "doc_id long, text string")
        best = 1e9
        for _ in range(2):
            began = time.perf_counter()
            (row,) = licenses.scan(docs).collect()
            best = min(best, time.perf_counter() - began)
        assert row.labels == "mit" and row.n_words == 2 * n
        took.append(best)
        n *= 4
    assert took[1] < 8 * took[0], "sixteen times, were it the square"


def test_runs_of_matches_are_one_list(spark, monkeypatch):
    texts = [(i, "Apache License 2.0 x " * i + "cc by " * (i % 3) + "y mit license") for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted(map(tuple, licenses.scan(docs).collect()))
    for run in (1, 3):
        monkeypatch.setattr(licenses, "RUN", run)
        assert sorted(map(tuple, licenses.scan(docs).collect())) == want
