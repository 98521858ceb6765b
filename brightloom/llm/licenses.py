"""License scan by ordered signature rules, on SQL functions only.

A text becomes its lower-case words with one space between them. Hundreds of
hand-written rules (``license_rules``) are gated twice: a few short strings decide
whether a text can hold any signature at all, then each rule's keyword decides
whether its regex runs. Detections are intervals of words. One that lies inside
another of equal or better priority is suppressed, so "mit license" says nothing
of its own within "permission ... mit license (expat)". All of it happens within
the row: no shuffle, no key, nothing to skew.
"""

from __future__ import annotations

import json
import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, read_table, row_of
from .license_rules import Rule, rules

#: Phrases whose places are counted and located, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: What a detection of each priority says about the text.
CONFIDENCE = {1: 1.0, 2: 0.85, 3: 0.6}
#: Matches of a rule that are placed in one list.
RUN = 128
#: The same for a base phrase.
BASE_CONFIDENCE = 0.5

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RULE = "array<struct<id:int,priority:int,label:string,keyword:string,regex:string>>"
_FOUND = "array<struct<start:int,back:int,priority:int,id:int,label:string>>"


def gates(found: list[Rule]) -> list[str]:
    """Short strings of which a text has one at least if any rule matches it."""
    out = set()
    for r in found:
        must, before = r.regex.removeprefix("(?<= )(?:").removesuffix(")(?= )"), ""
        while before != must:  # what no match can lack
            before, must = must, re.sub(r"\((?:\?:)?[^()]*\)(?:\?|\{[^}]*\})?|\[[^\]]*\]\?|.\?", "|", must)
        out.add("licen" if "licen" in must else r.keyword)
    return sorted(out)


def _spaces(x: Column) -> Column:
    return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))


def normal(text: Column) -> Column:
    """The words, A-Z lower-cased, one space between them and one at either end."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.regexp_replace(lower, _NOT_WORD, " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def _places(t: Column, r: Column) -> Column:
    """Intervals of words that a rule matches; ``back`` is minus the last word.

    Matches are placed in runs of RUN: appending to a list copies it, so one list of all
    matches would take time as their square.
    """
    segments, matches = F.split(t, r["regex"]), F.regexp_extract_all(t, r["regex"], F.lit(0))
    step = lambda acc, x: F.struct(
        (acc["at"] + _spaces(x["segment"]) + _spaces(x["match"])).alias("at"),
        F.array_append(
            acc["out"],
            F.struct(
                (acc["at"] + _spaces(x["segment"]) - 1).alias("start"),
                (1 - acc["at"] - _spaces(x["segment"]) - _spaces(x["match"])).alias("back"),
                r["priority"].alias("priority"),
                r["id"].alias("id"),
                r["label"].alias("label"),
            ),
        ).alias("out"),
    )
    pairs = F.zip_with(F.slice(segments, 1, F.size(matches)), matches, lambda s, m: F.struct(s.alias("segment"), m.alias("match")))
    # a lambda's variable is evaluated once: the matches are one, for all their runs
    cut_up = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int"))), lambda i: F.slice(p, i * RUN + 1, F.lit(RUN)))
    runs = F.flatten(F.transform(F.array(pairs), cut_up))

    def run(acc, these):
        zero = F.struct(acc["at"].alias("at"), F.array().cast(_FOUND).alias("out"))
        return F.aggregate(these, zero, step, lambda inner: F.struct(inner["at"].alias("at"), F.array_append(acc["out"], inner["out"]).alias("out")))

    return F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_FOUND}>").alias("out")), run, lambda acc: F.flatten(acc["out"]))


def _suppressed(found: Column) -> Column:
    """Labels and the best priority that stay. ``found`` is sorted by start, longest first.

    What lies before a detection in that order contains it if it ends no earlier,
    so the smallest ``back`` so far, by priority, is all that has to be carried.
    """
    far = 1

    def step(acc, d):
        inside = [acc[f"b{p}"] <= d["back"] for p in (1, 2, 3)]
        gone = F.element_at(F.array(*inside), d["priority"])
        carry = [F.when(d["priority"] <= p, F.least(acc[f"b{p}"], d["back"])).otherwise(acc[f"b{p}"]).alias(f"b{p}") for p in (1, 2, 3)]
        return F.struct(
            *carry,
            F.when(gone, acc["best"]).otherwise(F.least(acc["best"], d["priority"])).alias("best"),
            F.when(gone | F.array_contains(acc["labels"], d["label"]), acc["labels"]).otherwise(F.array_append(acc["labels"], d["label"])).alias("labels"),
        )

    zero = F.struct(*(F.lit(far).alias(f"b{p}") for p in (1, 2, 3)), F.lit(9).alias("best"), F.array().cast("array<string>").alias("labels"))
    return F.aggregate(found, zero, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["best"].alias("best")))


def scan(docs: DataFrame, text: str = "text", found: list[Rule] | None = None) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no word and no label. Rows are looked at one by one,
    so repeated rows and null ids change nothing; columns that have one of the new
    names are replaced. An empty table gives an empty table.
    """
    found = rules() if found is None else found
    table = F.from_json(F.lit(json.dumps([r._asdict() for r in found])), _RULE)
    base = "(?<= )(?:" + "|".join(BASE) + ")(?= )"
    kept = [c for c in docs.columns if c not in {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}]
    out = docs.select(row_of(kept), normal(named(text)).alias("_t"))
    t = F.col("_t")
    has = {label: t.contains(f" {phrase} ") for phrase, label in BASE.items()}
    any_base = F.greatest(*has.values())
    gate = t.contains(gates(found)[0])
    for g in gates(found)[1:]:
        gate = gate | t.contains(g)
    none = F.array().cast(_FOUND)
    out = out.select(
        "row",
        "_t",
        F.when(t == "  ", F.lit(0)).otherwise(_spaces(t) - 1).cast("long").alias("n_words"),
        F.when(any_base, F.regexp_extract_all(t, F.lit(base), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("_hits"),
        F.array_compact(F.array(*(F.when(has[x], F.lit(x)) for x in sorted(has)))).alias("_base"),
        F.when(gate, F.array_sort(F.flatten(F.transform(F.filter(table, lambda r: F.contains(t, r["keyword"])), lambda r: _places(t, r))))).otherwise(none).alias("_found"),
    )
    hit = F.size("_hits") > 0
    before = _spaces(F.substring(t, F.lit(1), F.regexp_instr(t, F.lit(base)) - 1)) - 1
    after = _spaces(F.element_at(F.split(t, base), -1)) - 1
    last = F.col("n_words") - after - _spaces(F.element_at("_hits", -1)) - 1
    out = out.select(
        "row",
        "n_words",
        F.size("_hits").cast("long").alias("n_base"),
        F.when(hit, before.cast("long")).alias("first_word"),
        F.when(hit, last.cast("long")).alias("last_word"),
        "_base",
        _suppressed(F.col("_found")).alias("_kept"),
    )
    best = F.col("_kept.best")
    score = F.when(best == 1, CONFIDENCE[1]).when(best == 2, CONFIDENCE[2]).when(best == 3, CONFIDENCE[3]).when(F.size("_base") > 0, BASE_CONFIDENCE).otherwise(0.0)
    return out.select(
        *(named(c, "row").alias(c) for c in kept),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", "_kept.labels")), ",").alias("labels"),
        score.alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).drop("text")
