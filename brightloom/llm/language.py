"""Language identification by rank-order n-gram profiles.

A language's profile is its most frequent n-grams of one to three letters, in order.
A document's own most frequent n-grams are compared with each profile by out-of-place
distance: how far every n-gram stands from its place there, the profile's length for
one that is missing.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import named, read_table, ship, with_fields

#: Length of a profile.
PROFILE = 300
UNKNOWN = "und"
#: Bits of a code point within an n-gram's code, which tells all n-grams of all scripts apart.
_BITS = 21
#: What codes of one, two and three letters begin with, so that they are in this order.
_TAGS = tuple(np.array([-(1 << 63), -(1 << 62), 0], np.int64))
#: Cells that values are counted in for a quantile.
CELLS = 1024
#: Letters of a text that are counted at a time, so that memory doesn't follow the longest text.
BLOCK = 1 << 20


class Model(NamedTuple):
    languages: list[str]
    #: For each language, codes of its n-grams in order.
    profiles: list[list[int]]


@functools.cache
def lettered() -> np.ndarray:
    """Each code point that is a letter, as itself; 0 for the others."""
    return np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.int32, 0x110000)


def letters(text: str) -> np.ndarray:
    """The text's code points in lower case, 0 for whatever is no letter."""
    return lettered()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]


def _counted(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams around all but the first and last place of ``c``, and their counts."""
    names, small = np.unique(np.append(c, 0), return_inverse=True)  # the first name is 0
    n = len(names)
    a, b, d = small[:-3], small[1:-2], small[2:-1]
    letter = b > 0
    pair = letter | (a > 0)
    out, counts = [], []
    for size, grams in enumerate((b[letter], a[pair] * n + b[pair], (a[letter] * n + b[letter]) * n + d[letter]), 1):
        if n**size <= 4 * len(grams):
            every = np.bincount(grams)
            found = np.flatnonzero(every)
            count = every[found]
        else:
            found, count = np.unique(grams, return_counts=True)
        code = np.full(len(found), _TAGS[size - 1])
        for k in range(size):
            code |= names[found // n**k % n].astype(np.int64) << (_BITS * k)
        out.append(code)
        counts.append(count)
    return np.concatenate(out), np.concatenate(counts)


def ngrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of words, borders counting as letters, and their counts.

    A code holds the n-gram's code points. Longer texts are counted block by block.
    """
    c = np.concatenate([[0], codes, [0]]).astype(np.int64)
    parts = [_counted(c[i : i + BLOCK + 2]) for i in range(0, len(codes), BLOCK)]
    if len(parts) == 1:
        return parts[0]
    return summed([p for p, _ in parts], [n for _, n in parts])


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several texts or blocks, added up."""
    found, at = np.unique(np.concatenate([*codes, np.empty(0, np.int64)]), return_inverse=True)
    return found, np.bincount(at, np.concatenate([*counts, np.empty(0, np.int64)]), len(found)).astype(np.int64)


def most_frequent(found: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    return found[np.lexsort((found, -counts))[:length]]


class Scorer:
    def __init__(self, model: Model, length: int = PROFILE) -> None:
        self.length, self.languages = length, model.languages
        self.codes = np.unique(np.array([c for p in model.profiles for c in p], np.int64))
        self.places = np.full((len(model.languages), len(self.codes) + 1), -1, np.int32)
        for i, p in enumerate(model.profiles):
            self.places[i, np.searchsorted(self.codes, np.array(p, np.int64))] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = letters(text or "")
        if not codes.any() or not self.languages:
            return UNKNOWN, 0.0
        top = most_frequent(*ngrams(codes), self.length)
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0
        places = self.places[:, np.where(self.codes[at] == top, at, len(self.codes))]
        out = np.where(places < 0, self.length, np.abs(places - np.arange(len(top)))).clip(max=self.length).sum(axis=1)
        best = int(out.argmin())
        return self.languages[best], 1.0 - float(out[best]) / (self.length * len(top))


def train_rows(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Labelled rows that may be learned from: doc_id's CRC isn't a multiple of 5."""
    rows = docs.select(named(id_col).alias("doc_id"), named(text).alias("text"), named(lang).alias("lang"))
    return rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))


def held_out(id_col: str) -> F.Column:
    """A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def learn(rows: DataFrame, length: int = PROFILE) -> Model:
    """Profiles from all ``rows`` (text, lang).

    N-grams are counted batch by batch and summed by Spark; only profiles reach the
    driver. No rows give a model of no language, which knows nothing.
    """
    ship(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                each = [ngrams(letters(t.as_py())) for name, t in zip(langs, batch.column("text"), strict=True) if name == lang and t.as_py()]
                found, total = summed([x for x, _ in each], [n for _, n in each])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(total, pa.int64())], ["lang", "code", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("i") <= length)
    profiles: dict[str, list[int]] = {}
    for r in ranked.select("lang", "i", "code").orderBy("lang", "i").collect():
        profiles.setdefault(r["lang"], []).append(r["code"])
    return Model(sorted(profiles), [profiles[x] for x in sorted(profiles)])


def quantile(values: DataFrame, share: float) -> float | None:
    """The exact quantile of the only column of ``values``, between neighbours by proportion; None of nothing.

    The value of a rank is found by counting values in CELLS of equal width and going on
    within the cell that has the rank: no task sees more than a count for each cell.
    """
    values = values.toDF("v").filter("v IS NOT NULL")
    n = values.count()
    if not n:
        return None
    rank = int(share * (n - 1))
    part, left = values, rank
    while True:
        low, high = part.agg(F.min("v"), F.max("v")).first()
        if low == high:
            break
        cell = F.least(F.floor((F.col("v") - low) / (high - low) * CELLS), F.lit(CELLS - 1))
        for r in sorted(part.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()):
            if left < r["n"]:
                break
            left -= r["n"]
        part = part.filter(cell == r["cell"])
    upto, above = values.agg(F.count_if(F.col("v") <= low), F.min(F.when(F.col("v") > low, F.col("v")))).first()
    following = low if upto > rank + 1 or above is None else above
    return low + (following - low) * (share * (n - 1) - rank)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score (0 to 1) from the whole text alone.

    ``und`` and 0 where the text is null, empty or has no letter. Rows are looked at
    one by one: repeated rows, null ids and an empty table need nothing. Columns that
    are called lang_pred or score are replaced.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in {"lang_pred", "score"}]
    rest = [c for c in kept if c != text]
    packed = docs.select(F.struct(F.lit(0).alias("c"), *(named(c).alias(f"c{i}") for i, c in enumerate(rest))).alias("row"), named(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["row", "text", "lang_pred", "score"])

    out = packed.mapInArrow(run, with_fields(packed, ["row", "text"], "lang_pred string, score double"))
    columns = [F.col("text").alias(c) if c == text else F.col(f"row.c{rest.index(c)}").alias(c) for c in kept]
    return out.select(*columns, "lang_pred", "score")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(train_rows(docs))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
