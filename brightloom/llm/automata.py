"""Removal of repeated word windows by suffix automata of reference shards.

Every document is a reference for those with larger ids. Passages around shared
anchors (``passages``) make up reference shards, by anchor hash; a shard's automaton
is built where its passages are, and the passages of all documents that could match
it are streamed over it for their matching statistics. Each state knows the smallest
document id that its words come from. An automaton of all reference text would grow
with the corpus, so it is the shard, of bounded size, that travels to a task, and a
document meets only the shards that hold one of its anchors. References that are a set
of their own, of bounded size, are broadcast (``remove_known``).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import passages
from .common import named, read_table, ship
from .passages import Units, mix

SPAN = 50
#: Words of passages that one automaton is built from at most, but for a larger bucket.
AUTOMATON_WORDS = 60_000
#: Bytes of text of a shard of outside references, whose automaton is broadcast.
REFERENCE_BYTES = 1 << 20
WINDOWS = "array<struct<first:int,last:int>>"
#: Word hashes that a worker keeps.
WORDS_KEPT = 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _grams(words: list[bytes]) -> np.ndarray:
    """Hashes of the 8-word q-grams."""
    g = word_hashes(words)
    for d in (1, 2, 4):
        g = mix(g[:-d], g[d:])
    return g


def word_units(span: int = SPAN) -> Units:
    if span < 9:
        raise ValueError("spans of less than 9 words have no anchor")
    return Units(span, 8, bytes.split, _grams, b" ".join)


class Automaton:
    """Suffix automaton of several word sequences, each with a document id.

    Most states have one transition; it stands in flat arrays, and only states that
    branch have a table, so a state takes some thirty bytes.
    """

    def __init__(self) -> None:
        self.word: list[bytes | None] = [None]
        self.to, self.link, self.length = array("i", [0]), array("i", [-1]), array("i", [0])
        self.least = array("q", [passages.NO_ID])
        self.more: dict[int, dict[bytes, int]] = {}

    def step(self, s: int, word: bytes) -> int | None:
        if self.word[s] == word:
            return self.to[s]
        table = self.more.get(s)
        return table.get(word) if table else None

    def _set(self, s: int, word: bytes, to: int) -> None:
        if self.word[s] is None or self.word[s] == word:
            self.word[s], self.to[s] = word, to
        else:
            self.more.setdefault(s, {})[word] = to

    def _state(self, length: int, like: int | None, link: int) -> int:
        new = len(self.word)
        self.word.append(None if like is None else self.word[like])
        self.to.append(0 if like is None else self.to[like])
        if like in self.more:
            self.more[new] = dict(self.more[like])
        self.link.append(link)
        self.length.append(length)
        self.least.append(passages.NO_ID)
        return new

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state of p's longest string and the word, apart from q's longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, q, self.link[q])
        self.link[q] = clone
        while p != -1 and self.step(p, word) == q:
            self._set(p, word, clone)
            p = self.link[p]
        return clone

    def add(self, words: list[bytes], doc: int) -> None:
        step, link, least = self.step, self.link, self.least
        last = 0
        for word in words:
            q = step(last, word)
            if q is not None:
                last = self._split(last, word, q)
            else:
                new, p = self._state(self.length[last] + 1, None, 0), last
                while p != -1 and (q := step(p, word)) is None:
                    self._set(p, word, new)
                    p = link[p]
                if p != -1:
                    link[new] = self._split(p, word, q)
                last = new
            if doc < least[last]:
                least[last] = doc

    def close(self) -> None:
        """Every state learns the smallest id of all places where its strings end."""
        for s in np.argsort(-np.frombuffer(self.length, np.int32), kind="stable").tolist():
            p = self.link[s]
            if p != -1 and self.least[s] < self.least[p]:
                self.least[p] = self.least[s]

    def statistics(self, words: list[bytes], span: int) -> list[int | None]:
        """For each window of ``span`` words the smallest id that has it, or None.

        The state keeps a suffix of what was read that is as short as it can be with
        ``span`` words or more; on a mismatch it falls back along suffix links.
        """
        step, link, length = self.step, self.link, self.length
        state, matched, out = 0, 0, []
        for i, word in enumerate(words):
            while (to := step(state, word)) is None and state:
                state = link[state]
                matched = length[state]
            state = to or 0
            matched = matched + 1 if state else 0
            while state and length[link[state]] >= span:
                state = link[state]
                matched = length[state]
            if i >= span - 1:
                out.append(self.least[state] if matched >= span else None)
        return out


def _decide(span: int):
    def shard(rows: list[tuple[int, list[bytes], int]]) -> list[list[tuple[int, int, int]]]:
        automaton = Automaton()
        for _, words, doc in rows:
            automaton.add(words, doc)
        automaton.close()
        found = []
        for _, words, _ in rows:
            runs: list[list[int]] = []
            for i, least in enumerate(automaton.statistics(words, span)):
                if runs and runs[-1][2] == least:
                    runs[-1][1] = i
                else:
                    runs.append([i, i, least])
            found.append([(a, b, least) for a, b, least in runs])
        return found

    def decide(keys: np.ndarray, passages_: list[bytes], docs: np.ndarray, copies: np.ndarray, number: int) -> tuple[np.ndarray, ...]:
        out: list[list[tuple[int, int, int]]] = []
        held: list[tuple[int, list[bytes], int]] = []
        size = 0
        same: dict[bytes, bytes] = {}
        for key, passage, doc in zip(keys.tolist(), passages_, docs.tolist(), strict=True):
            words = [same.setdefault(w, w) for w in passage.split()]
            if held and held[-1][0] != key and size + len(words) > AUTOMATON_WORDS:
                out += shard(held)
                held, size = [], 0
            held.append((key, words, doc))
            size += len(words)
        out += shard(held)
        found = np.array([(i, *run) for i, runs in enumerate(out) for run in runs], np.int64).reshape(-1, 4)
        return tuple(found.T)

    return decide


def remove_repeats(docs: DataFrame, span: int = SPAN, text: str = "text", id_col: str = "doc_id", carry: list[str] | None = None, with_kept: bool = True) -> DataFrame:
    """Remove every word in a window of ``span`` words that starts in a smaller id's text.

    Returns ``row`` (a struct of the ``carry`` columns, all by default), n_units
    (words), n_removed, n_spans, kept_sha256 and kept (words joined by one space).
    Null text has no words. A null id is larger than every other; rows of one id
    remove nothing from each other. Columns may have any names: they travel inside
    ``row``.
    """
    units = word_units(span)
    rows = passages.keyed(docs, text, id_col, docs.columns if carry is None else carry)
    anchors = passages.anchor_table(rows, units)
    places = passages.passage_table(rows, anchors, units)
    runs = passages.resolved(places, _decide(span), units)
    windows = passages.located(places, runs, F.col("value") < F.col("doc"))
    return passages.without(rows, anchors, windows, units, F.col("doc") > F.col("min_doc"), with_kept)


def remove_known(docs: DataFrame, references: DataFrame, span: int = SPAN, text: str = "text", id_col: str = "doc_id", carry: list[str] | None = None, with_kept: bool = True) -> DataFrame:
    """Remove every word in a window of ``span`` words that stands in a reference text.

    For references of their own, such as texts that are published already: their shards
    of about REFERENCE_BYTES are taken one by one, the shard's automaton is broadcast, and
    all documents stream over it. No document is shuffled, so no text of any number of
    copies matters. Returns what ``remove_repeats`` does; null texts and null references
    have no words, and no reference leaves documents as they are.
    """
    units, spark = word_units(span), docs.sparkSession
    ship(spark)
    rows = passages.keyed(docs, text, id_col, docs.columns if carry is None else carry).select("row", "text", "absent")
    marked = rows.withColumn("windows", F.lit(None).cast(WINDOWS))
    total = references.agg(F.sum(F.octet_length(named(text)))).first()[0] or 0
    shards = -(-total // REFERENCE_BYTES)
    dealt = references.select(named(text).alias("t"), F.pmod(F.xxhash64(named(text)), F.lit(shards or 1)).alias("s"))
    for shard in range(shards):
        automaton = Automaton()
        for r in dealt.filter(F.col("s") == shard).select("t").distinct().toLocalIterator():
            automaton.add((r["t"] or "").encode().split(), 0)
        automaton.close()
        held = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for t, before in zip(batch.column("text"), batch.column("windows").to_pylist(), strict=True):
                    found = [i for i, least in enumerate(held.value.statistics(t.as_py().encode().split(), span)) if least is not None]
                    runs = np.split(found, np.flatnonzero(np.diff(found) != 1) + 1) if found else []
                    out.append((before or []) + [{"first": int(r[0]), "last": int(r[-1])} for r in runs])
                yield batch.set_column(batch.schema.get_field_index("windows"), "windows", pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))))

        marked = marked.mapInArrow(run, marked.schema)
    return passages.cut_out(marked.withColumns({"whole": F.lit(False), "shorter": F.lit(None).cast(WINDOWS)}), units, with_kept)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"), carry=["doc_id"], with_kept=False)
    return out.select("row.doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")
