"""Compression of vectors to codes, with nearest entries found by annular norm pruning.

Vectors of integers are cut into equal parts, and each part is replaced by the number of
its nearest entry in a codebook of its position. An entry can't be nearer to a part than
their norms differ. So entries are sorted by norm and evaluated, exactly, outward from
the part's own norm; two binary searches give the interval of norms that the best
distance so far allows, both ends included, and nothing outside that annulus is evaluated.
All arithmetic is on integers; norms only choose what is evaluated.

Codebooks are refined in rounds. A task sums the parts of each entry before anything is
shuffled, so what is sent, and what the driver gets, is as large as the codebooks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, named, read_table, row_of, ship, stored, with_fields

#: A component x becomes floor(SCALE * x).
SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries to either side, in order of norm, that a part is held against before its annulus is searched anew.
STEP = 4
#: Parts that are held against the entries of their annuli at a time.
CHUNK = 8192
#: Labels up to which the table of their errors is broadcast; beyond, it is joined.
BROADCAST_LABELS = 65_536


def limit(size: int) -> int:
    """The largest component of vectors of so many whose squared distances fit a long for certain."""
    return math.isqrt((1 << 62) // size) // 2


class Annuli:
    """The entries of one codebook, sorted by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.entries, self.order = entries, np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each part its nearest entry, the lowest of equally near ones, the squared
        distance, and how many entries were evaluated in all."""
        found = [self._nearest(parts[at : at + CHUNK]) for at in range(0, len(parts), CHUNK)]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), sum(x[2] for x in found)

    def _nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Outward from the part's own norm, STEP entries to either side at a time, as far as the best distance
        so far allows. What has been evaluated are the entries from ``low`` to ``high`` in order of norm."""
        norms, k = np.sqrt((parts.astype(np.float64) ** 2).sum(1)), len(self.norms)
        best, least = np.full(len(parts), k), np.full(len(parts), np.iinfo(np.int64).max)
        low = high = np.searchsorted(self.norms, norms)
        open_, looked = np.arange(len(parts)), 0
        while len(open_):
            radius = np.sqrt(least[open_].astype(np.float64))
            slack = 1e-9 * (norms[open_] + radius + 1)  # more than the rounding of norms, so no entry on the edge is left out
            first = np.searchsorted(self.norms, norms[open_] - radius - slack, "left")
            last = np.searchsorted(self.norms, norms[open_] + radius + slack, "right")
            more = (first < low) | (last > high)
            open_, low, high, first, last = (x[more] for x in (open_, low, high, first, last))
            below, above = np.minimum(low, np.maximum(first, low - STEP)), np.maximum(high, np.minimum(last, high + STEP))
            counts = low - below + above - high
            begins = np.cumsum(counts) - counts
            part = np.repeat(np.arange(len(open_)), counts)
            place = np.repeat(below - begins, counts) + np.arange(len(part))
            entry = self.order[place + np.where(place >= low[part], (high - low)[part], 0)]
            difference = parts[open_[part]] - self.entries[entry]
            distance = np.einsum("ij,ij->i", difference, difference)
            if len(part):
                near = np.minimum.reduceat(distance, begins)
                which = np.minimum.reduceat(np.where(distance == near[part], entry, k), begins)
                better = (near < least[open_]) | ((near == least[open_]) & (which < best[open_]))
                best[open_[better]], least[open_[better]] = which[better], near[better]
            low, high, looked = below, above, looked + len(part)
        return best, least, looked


def integers(vectors: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """``row`` and x, the vector as integers, of the rows whose vector has components and only finite ones.

    A component beyond ``limit`` counts as that (262144 for 64 components and a scale of
    256, times two): squared distances would not fit a long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("x")
            offsets, values = column.offsets.to_numpy(), column.values
            numbers = values.to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers) | values.is_null().to_numpy(zero_copy_only=False))])
            sizes = np.diff(offsets)
            keep = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0) & (bad[offsets[1:]] == bad[offsets[:-1]]))
            bounds = np.repeat([limit(n) for n in sizes[keep].tolist()], sizes[keep])
            at = np.repeat(offsets[keep] - np.cumsum(sizes[keep]) + sizes[keep], sizes[keep]) + np.arange(sizes[keep].sum())
            whole = np.clip(np.floor(scale * numbers[at]), -bounds, bounds).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[keep])]), pa.int32()), pa.array(whole))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(keep)), lists], ["row", "x"])

    source = vectors.select("row", named(vector, "row").alias("x"))
    return source.mapInArrow(run, with_fields(source, ["row"], "x array<int>"))


def _matrix(column: pa.ListArray, parts: int) -> np.ndarray:
    """Parts by vector, part and component."""
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), parts, -1)


def refined(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks whose entries are the means, rounded down, of the parts they are nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(b) for b in books]
        sums, counts = np.zeros((len(books), *books[0].shape), np.int64), np.zeros((len(books), len(books[0])), np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), len(books))
            for p, a in enumerate(annuli):
                best, _, _ = a.nearest(x[:, p])
                np.add.at(sums[p], best, x[:, p])
                counts[p] += np.bincount(best, minlength=len(books[p]))
        part, entry = np.nonzero(counts)
        values = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(values, ["part", "entry", "n", "sums"])

    partial = rows.select("x").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    total = partial.select("part", "entry", "n", F.posexplode("sums").alias("at", "sum")).groupBy("part", "entry", "at")
    out = [b.copy() for b in books]
    for r in total.agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect():
        out[r["part"]][r["entry"], r["at"]] = int(r["sum"]) // r["n"]
    return out


class Compressed(NamedTuple):
    #: ``row``, code (a byte for each part), error (squared distances summed) and n_evaluated (entries held against its parts).
    codes: DataFrame
    #: For each part position its entries by component.
    codebooks: list[np.ndarray]


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vector: str = "embedding", id_col: str = "vec_id", carry: list[str] | None = None) -> Compressed:
    """Codes of vectors, each with a ``row`` of the ``carry`` columns (all by default).

    Codebooks start as the parts of the vectors with the smallest ids (of equal ids the
    smallest vectors; null ids are the largest) and are refined in so many rounds; an
    entry that no part is nearest to stays. Vectors that are null, empty or hold a null
    or non-finite component are dropped, and so are those with another number of
    components than the one of the smallest id has. That number must be a multiple of
    ``parts``. Repeated rows each get the code. With fewer vectors than entries there are
    fewer entries; an empty table has no codebook. Columns may have any names.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte for each part")
    ship(vectors.sparkSession)
    wanted = vectors.columns if carry is None else carry
    rows = stored(integers(vectors.select(row_of([*wanted, *(c for c in dict.fromkeys((id_col, vector)) if c not in wanted)])), vector, scale))
    order = [named(id_col, "row").asc_nulls_last(), "x"]
    first = rows.orderBy(*order).select("x").first()
    if first is None:
        books = []
    else:
        size = len(first["x"])
        if size % parts:
            raise ValueError(f"{size} components don't make {parts} equal parts")
        rows = rows.filter(F.size("x") == size)
        start = np.array([r["x"] for r in rows.orderBy(*order).select("x").limit(entries).collect()], np.int64).reshape(-1, parts, size // parts)
        books = [start[:, p] for p in range(parts)]
        for _ in range(rounds):
            books = refined(rows, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(b) for b in books]
        for batch in batches:
            n = batch.num_rows if annuli else 0
            codes, errors, evaluated = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64), 0
            x = _matrix(batch.column("x"), parts) if n else None
            for p, a in enumerate(annuli if n else []):
                best, distance, looked = a.nearest(x[:, p])
                codes[:, p], evaluated = best, evaluated + looked
                errors += distance
            looked_each = np.full(n, evaluated // max(1, n), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(0, n), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors), pa.array(looked_each)], ["row", "code", "error", "n_evaluated"])

    found = rows.mapInArrow(run, with_fields(rows, ["row"], "code binary, error bigint, n_evaluated bigint"))
    return Compressed(found.select(F.struct(*(named(c, "row").alias(c) for c in wanted)).alias("row"), "code", "error", "n_evaluated"), books)


def decoded(code: bytes, codebooks: list[np.ndarray]) -> np.ndarray:
    """The vector of integers that a code stands for."""
    return np.concatenate([b[i] for b, i in zip(codebooks, code, strict=True)])


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, in decimal, with commas."""
    import hashlib

    return hashlib.sha256(",".join(str(v) for b in codebooks for v in b.ravel().tolist()).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(read_table(spark, sf_dir, "embeddings"), carry=["vec_id", "label"])
    each = stored(codes.select("row.vec_id", "row.label", F.lower(F.hex("code")).alias("code"), "error"))
    errors = cut(each.groupBy("label").agg(F.try_sum("error").alias("label_error")))
    errors = F.broadcast(errors) if errors.count() <= BROADCAST_LABELS else errors
    found = each.alias("e").join(errors.alias("l"), F.col("e.label").eqNullSafe(F.col("l.label")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
