"""op12: exact round trips, and the transformation against plain slicing."""

import hashlib

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from brightloom.llm import fill_middle as fim

UNITS = regex.compile(fim.UNITS)
SPACE = " \t\n\x0b\x0c\r"


def units_by_hand(text):
    """White space and the word after it, character by character."""
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in SPACE:
            end += 1
        while end < len(text) and text[end] not in SPACE:
            end += 1
        out.append(text[at:end])
        at = end
    return out


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**6), st.text(alphabet="ab <PSM>\t\n\x85\xa0é日", max_size=40))
def test_parts_are_whole_units_and_come_back(doc_id, text):
    cut = fim.cut_text(doc_id, text, UNITS, percent=100)
    units = units_by_hand(text)
    assert cut.n == len(units)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if cut.form == "plain":
        assert not text or any(x in text for x in ("<P>", "<S>", "<M>"))
    else:
        assert (cut.prefix, cut.middle, cut.suffix) == ("".join(units[:low]), "".join(units[low:high]), "".join(units[high:]))
        assert cut.form == ("spm" if h4 % 100 < 80 else "psm")
    assert fim.restored(fim.assembled(text, cut), cut.form) == text


@pytest.mark.parametrize("form", ["psm", "spm"])
@pytest.mark.parametrize("parts", [("", "", "x"), ("<", "S>", "P"), ("a<P", ">", "<M"), ("", "", "")])
def test_marks_that_parts_nearly_make(form, parts):
    cut = fim.Cut(1, form, *parts)
    assert fim.restored(fim.assembled("", cut), form) == "".join(parts)


def test_query_on_odd_rows(spark):
    long = "word  " * 200_000 + "é"
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one <S> two"), (None, "a b c"), (5, long), (5, long), (6, "\x00 nul \x1c"), (-7, "a b c d e f g h")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, `a.b` int")
    out = fim.with_restored(fim.fill_in_middle(docs, percent=100)).collect()
    assert len(out) == len(rows)
    for r in out:
        text, key = r.row.text or "", r.row.doc_id
        cut = fim.cut_text(key, text, UNITS, percent=100)
        assert (r.n, r.form) == (len(units_by_hand(text)), cut.form)
        assert r.output == fim.assembled(text, cut) and r.restored == text
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.prefix_chars is None) == (r.form == "plain") == (not text or "<S>" in text)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_shares_of_forms(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'a b c d' AS text")
    n = {r.form: r["count"] for r in fim.fill_in_middle(docs).groupBy("form").count().collect()}
    assert abs(n["plain"] - 10_000) < 400 and abs(n["spm"] - 8_000) < 400 and abs(n["psm"] - 2_000) < 300
