"""Chroma audio fingerprints of media columns.

A recording's spectrum is folded to twelve pitch classes for each frame. Filters of
an integral image over (frame, pitch class) compare rectangles of it; each answers in
two bits, and sixteen of them pack one integer for each frame. Recordings are aligned
by the histogram of offsets at which integers are equal, but for bits that were
uncertain, and compared by the share of bits that differ at each offset in it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, read_table, row_of, ship, stored, with_fields

RATE, FRAME, HOP = 8000, 1024, 512
#: Octaves of A that are folded, in Hz.
LOWEST, HIGHEST = 110.0, 1760.0
#: Frames that one integer looks at.
WIDTH = 8
#: What a filter's answer is compared with: below, between or above.
THRESHOLDS = (-0.25, 0.0, 0.25)
#: Recordings match with at most so many of a hundred bits different, over at least
#: so many integers.
MOST_BITS, LEAST_ALIGNED = 25, 64
#: Bits of each of a query's integers that may be turned: those of the answers nearest to
#: a threshold. Each one doubles the integers that are looked up.
WEAK = 4
#: Integers of the queries that are held against all recordings in one pass.
QUERY_CODES = 1 << 19
#: Equal integers of a recording and the queries that are paired at a time.
HITS = 1 << 20
#: Every so many ids is a query.
QUERY_STEP = 20


@functools.cache
def folding() -> np.ndarray:
    """Spectrum bins to pitch classes."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(f), 12))
    use = (f >= LOWEST) & (f <= HIGHEST)
    out[np.flatnonzero(use), np.round(12 * np.log2(f[use] / LOWEST)).astype(int) % 12] = 1
    return out


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Pitch-class energies of each frame, smoothed over five and of length 1."""
    if len(pcm) < FRAME:
        return np.empty((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float64), FRAME)[::HOP] * np.hanning(FRAME)
    energy = np.abs(np.fft.rfft(frames, axis=1)) ** 2 @ folding()
    padded = np.pad(energy, ((2, 2), (0, 0)))
    smooth = sum(w * padded[i : i + len(energy)] for i, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    norm = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.divide(smooth, norm, out=np.zeros_like(smooth), where=norm > 1e-9)


@functools.cache
def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames) of the sixteen filters."""
    return [(i % 6, (5 * i) % 7, 3 + i % 4 if i % 6 != 1 else 4, (2, 4, 8)[i % 3]) for i in range(16)]


def answers(pcm: np.ndarray) -> np.ndarray:
    """The sixteen filters' answers for each frame that has WIDTH frames from it on."""
    c = chroma(pcm)
    n = len(c) - WIDTH + 1
    if n <= 0:
        return np.empty((0, 16))
    image = np.pad(np.cumsum(np.cumsum(c, axis=0), axis=1), ((1, 0), (1, 0)))
    t = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[t + t1, p1] - image[t + t0, p1] - image[t + t1, p0] + image[t + t0, p0]

    out = np.empty((n, 16))
    for i, (kind, p, h, w) in enumerate(filters()):
        q, v = p + h // 2, w // 2
        whole = area(0, w, p, p + h)
        if kind == 0:
            a, b = whole, area(0, w, 0, 12) * (h / 12)
        elif kind == 1:
            a = area(0, w, q, p + h)
            b = whole - a
        elif kind == 2:
            a = area(v, w, p, p + h)
            b = whole - a
        elif kind == 3:
            a = area(0, v, p, q) + area(v, w, q, p + h)
            b = whole - a
        elif kind == 4:
            a = area(0, w, p + 1, p + h - 1) * (h / max(1, h - 2))
            b = whole
        else:
            a = area(w // 4, w - w // 4, p, p + h) * 2
            b = whole
        out[:, i] = np.log((1 + a) / (1 + b))
    return out


def _gray(level: np.ndarray) -> np.ndarray:
    return level ^ (level >> np.uint32(1))


def packed(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One integer for each frame, two bits an answer; and its least certain bits.

    Neighbouring levels differ in one bit, so an answer near a threshold makes one bit
    uncertain. The WEAK bits nearest to theirs are given as places of five bits each.
    """
    limits = np.array(THRESHOLDS)
    level = (found[:, :, None] >= limits).sum(axis=2).astype(np.uint32)
    shift = np.uint32(2) * np.arange(15, -1, -1, dtype=np.uint32)
    codes = (_gray(level) << shift).sum(axis=1, dtype=np.uint32)
    nearest = np.abs(found[:, :, None] - limits).argmin(axis=2)
    beyond = np.where(level > nearest, nearest, nearest + 1).astype(np.uint32)
    bit = shift + (_gray(level) ^ _gray(beyond)) // np.uint32(2)
    first = np.argsort(np.abs(found - limits[nearest]), axis=1, kind="stable")[:, :WEAK]
    return codes, (np.take_along_axis(bit, first, 1).astype(np.int64) << (5 * np.arange(WEAK))).sum(axis=1)


def fingerprint(pcm: np.ndarray) -> np.ndarray:
    """One packed integer for each frame that has WIDTH frames from it on."""
    return packed(answers(pcm))[0]


def fingerprints(media: DataFrame, column: str = "pcm", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the ``carry`` columns), codes and weak of a column of 16-bit PCM at RATE.

    ``weak`` has the least certain bits of each code (``packed``). Null, empty and too
    short recordings have no codes. Rows are looked at one by one.
    """
    ship(media.sparkSession)
    source = media.select(row_of([c for c in media.columns if c != column] if carry is None else carry), named(column).alias("pcm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [packed(answers(np.frombuffer((x.as_py() or b"")[: (len(x.as_py() or b"") // 2) * 2], "<i2"))) for x in batch.column("pcm")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([c.astype(np.int64) for c, _ in found], pa.list_(pa.int64())), pa.array([w for _, w in found], pa.list_(pa.int64()))], ["row", "codes", "weak"])

    return source.mapInArrow(run, with_fields(source, ["row"], "codes array<bigint>, weak array<bigint>"))


def different(query: np.ndarray, other: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of bits that differ at an offset, and integers compared."""
    a, b = query[max(0, -offset) :], other[max(0, offset) :]
    n = min(len(a), len(b))
    return (float(np.bitwise_count(a[:n] ^ b[:n]).sum()) / (32 * n) if n else 1.0), n


def all_different(queries: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``different`` for many queries at once, parts of one array of joined codes."""
    at = np.arange(sizes.max(initial=0))
    place = at + offsets[:, None]
    valid = (at < sizes[:, None]) & (place >= 0) & (place < len(other))
    mine = queries[np.minimum(starts[:, None] + at, len(queries) - 1)]
    bits = np.where(valid, np.bitwise_count(mine ^ other[place.clip(0, len(other) - 1)]), 0).sum(axis=1)
    n = valid.sum(axis=1)
    return np.where(n > 0, bits / np.maximum(32 * n, 1), 1.0)


class Index:
    """Codes of a block of queries, each also with any of its least certain bits turned."""

    def __init__(self, queries: list[tuple[int, np.ndarray, np.ndarray | None]]) -> None:
        self.ids = [q[0] for q in queries]
        self.sizes = np.array([len(c) for _, c, _ in queries], np.int64)
        self.starts = np.cumsum([0, *self.sizes])[:-1]
        self.codes = np.concatenate([*(c for _, c, _ in queries), np.empty(0, np.uint32)])
        weak = np.concatenate([*(np.full(len(c), -1) if w is None else w for _, c, w in queries), np.empty(0, np.int64)])
        probes = [self.codes]
        for k in range(WEAK):
            turned = np.where(weak < 0, 0, np.uint32(1) << ((weak >> 5 * k) & 31).astype(np.uint32)).astype(np.uint32)
            probes += [p ^ turned for p in probes]
        at = np.tile(np.arange(len(self.codes), dtype=np.int32), len(probes))
        names = np.concatenate(probes)
        order = np.argsort(names, kind="stable")
        self.names, self.at = names[order], at[order]

    def matches(self, other: np.ndarray) -> dict[int, tuple[float, int]]:
        """For each query number that matches: fewest bits different, and at which offset.

        Every offset at which a code of the index stands is verified.
        """
        a, b = np.searchsorted(self.names, other), np.searchsorted(self.names, other, "right")
        n = b - a
        # silence is one integer throughout: pairs are made for some integers at a time, and only their offsets are kept
        cuts = np.flatnonzero(np.diff(np.cumsum(n) // HITS)) + 1
        histogram = np.empty(0, np.int64)
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(other)], strict=True):
            hit = self.at[np.repeat(a[i:j] - np.cumsum(n[i:j]) + n[i:j], n[i:j]) + np.arange(n[i:j].sum())]
            q = np.searchsorted(self.starts, hit, "right") - 1
            offset = np.repeat(np.arange(i, j), n[i:j]) - (hit - self.starts[q])
            enough = np.minimum(self.sizes[q], len(other) - offset) - np.maximum(0, -offset) >= LEAST_ALIGNED
            histogram = np.union1d(histogram, q[enough] * (1 << 32) + offset[enough] + (1 << 31))
        q, offset = histogram >> 32, (histogram & ((1 << 32) - 1)) - (1 << 31)
        order = np.argsort(self.sizes[q], kind="stable")
        q, offset = q[order], offset[order]
        found: dict[int, tuple[float, int]] = {}
        at = 0
        while at < len(q):
            end = at + max(1, (1 << 18) // int(self.sizes[q[min(len(q) - 1, at + 4096)]]))
            share = all_different(self.codes, self.starts[q[at:end]], self.sizes[q[at:end]], other, offset[at:end])
            for i in np.flatnonzero(share * 100 <= MOST_BITS).tolist():
                this = (float(share[i]), int(offset[at + i]))
                found[int(q[at + i])] = min(found.get(int(q[at + i]), this), this)
            at = end
        return found


def search(recordings: DataFrame, is_query: F.Column, id_col: str = "id") -> DataFrame:
    """For each query its matches among all other recordings, one row each query.

    ``recordings`` has ``id_col`` (a long), codes, and weak if queries are to be looked
    for with their least certain bits turned. Returns id, n_matches, best_id (fewest bits
    different, then the smallest id), best_offset and best_difference, null where nothing
    matches. Recordings of one id don't match each other; a null id is no query and
    matches none; recordings without codes match nothing.

    Queries are held against all recordings in blocks of about QUERY_CODES integers; every
    recording is looked up by all its integers, and each offset at which one is equal is
    verified. Each batch sends one row for each query it matches.
    """
    spark = recordings.sparkSession
    ship(spark)
    weak = F.col("weak") if "weak" in recordings.columns else F.lit(None).cast("array<bigint>")
    rows = recordings.select(named(id_col).cast("bigint").alias("id"), "codes", weak.alias("weak")).filter("id IS NOT NULL")
    asked = rows.filter(is_query)
    total = asked.agg(F.sum(F.size("codes"))).first()[0] or 0
    blocks = -(-total // QUERY_CODES) or 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        queries = [(r["id"], np.array(r["codes"], np.uint32), None if r["weak"] is None else np.array(r["weak"], np.int64)) for r in asked.filter(F.col("block") == block).collect() if r["codes"]]
        held = spark.sparkContext.broadcast(queries)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = Index(held.value)
            for batch in batches:
                best: dict[int, list] = {}
                for other_id, other in zip(batch.column("id").to_pylist(), batch.column("codes"), strict=True):
                    for i, (difference, offset) in index.matches(np.array(other.as_py() or [], np.uint32)).items():
                        query_id = index.ids[i]
                        if query_id != other_id:
                            x = best.setdefault(query_id, [0, (2.0, 0, 0)])
                            x[0] += 1
                            x[1] = min(x[1], (difference, other_id, offset))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(best), pa.int64()), pa.array([x[0] for x in best.values()], pa.int64()), *(pa.array([x[1][i] for x in best.values()], k) for i, k in enumerate((pa.float64(), pa.int64(), pa.int64())))],
                    ["id", "n", "difference", "other", "offset"],
                )

        part = rows.select("id", "codes").mapInArrow(run, "id bigint, n bigint, difference double, other bigint, offset bigint")
        found = part if found is None else found.unionAll(part)
    best = found.groupBy("id").agg(F.sum("n").alias("n_matches"), F.min(F.struct("difference", "other", "offset")).alias("b"))
    out = asked.select("id").distinct().join(best, "id", "left")
    return out.select("id", F.coalesce("n_matches", F.lit(0).cast("bigint")).alias("n_matches"), F.col("b.other").alias("best_id"), F.col("b.offset").alias("best_offset"), F.col("b.difference").alias("best_difference"))


def tune(vector: list[float] | None) -> bytes:
    """A recording made from a vector: one note of two frames for each number.

    Its size picks one of 24 semitones, so near-equal vectors sound alike but for a
    note here and there.
    """
    if vector is None or not len(vector):
        return b""
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector], np.float64))
    spread = float(np.sqrt((v**2).mean())) or 1.0
    note = np.clip(np.round(v / spread * 4 + 12), 0, 23)
    t = np.arange(len(v) * FRAME)
    return (np.sin(2 * np.pi * np.repeat(220.0 * 2 ** (note / 12), FRAME) * t / RATE) * 12000).astype("<i2").tobytes()


def tunes(vectors: DataFrame, vector: str, carry: list[str]) -> DataFrame:
    """A media column ``pcm`` from a vector column, since the tables hold no audio."""
    ship(vectors.sparkSession)
    source = vectors.select(*map(named, carry), named(vector).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array([tune(x.as_py()) for x in part.column("vector")], pa.binary())], [*carry, "pcm"])

    return source.mapInArrow(run, with_fields(source, carry, "pcm binary"))


def op5_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = tunes(read_table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])
    recordings = stored(fingerprints(media).select("row.vec_id", "codes", "weak"))
    return search(recordings.withColumnRenamed("vec_id", "id"), F.col("id") % QUERY_STEP == 0).withColumnRenamed("id", "vec_id")
