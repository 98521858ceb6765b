"""Joins by order: as-of and interval joins, without a loop over pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells of equal width that time is counted in, and rows that a stretch made of cells has at most but for its last cell.
CELLS, STRETCH_ROWS = 4096, 500_000
#: How much wider than bins of their own level the bins of intervals may be, by the sum over all intervals.
WIDER = 4


def _stretches(rows: DataFrame, at: str, per: int) -> Column:
    """A number for the stretch of time that a row is in: stretches have about ``per`` rows, whatever their keys.

    Rows are counted in CELLS of equal width, so CELLS numbers reach the driver.
    """
    low, high = rows.agg(F.min(at), F.max(at)).first()
    if low is None:
        return F.lit(0)
    width = (high - low) // CELLS + 1
    cell = F.floor((F.col(at) - low) / width).cast("int")
    counts = {r["cell"]: r["n"] for r in rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds, stretch, held = [], 0, 0
    for c in range(max(counts) + 1):
        if held and held + counts.get(c, 0) > per:
            stretch, held = stretch + 1, 0
        held += counts.get(c, 0)
        bounds.append(stretch)
    return F.element_at(F.expr(f"array({', '.join(map(str, bounds))})"), cell + 1)


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), tie: Sequence[str] = (), within: int | None = None, matched: str = "match", rows_per_task: int = STRETCH_ROWS) -> DataFrame:
    """Each row of ``left`` with ``matched``: the last row of ``right``, as a struct, that is not after it.

    ``on`` is a number that both have (times: ``unix_micros``), ``by`` columns that have
    to be equal, and of rows of ``right`` at one time the last in the order of ``tie``
    counts. The struct is null where no row is, or none at most ``within`` before. Rows
    of ``left`` stay all, also with a null key or time, which match nothing; those of
    ``right`` match nothing then either.

    Both sides are one table, sorted, along which the last row of ``right`` is carried. A
    key is split into stretches of time, so that one key of any size is many tasks: what
    each stretch ends with is carried from one to the next in a table of a row for each.
    """
    usable = F.col(on).isNotNull()
    for k in by:
        usable = usable & F.col(k).isNotNull()
    both_sides = left.columns, right.columns
    a = left.filter(usable).select(F.col(on).cast("bigint").alias("_at"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), F.lit(1).alias("_side"), F.struct(*both_sides[0]).alias("_l"))
    b = right.filter(usable).select(F.col(on).cast("bigint").alias("_at"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), F.lit(0).alias("_side"), F.struct(*both_sides[1]).alias("_r"))
    keys = [f"_k{i}" for i in range(len(by))]
    rows = a.unionByName(b, allowMissingColumns=True)
    rows = rows.withColumn("_stretch", _stretches(rows, "_at", rows_per_task))
    order = ["_at", "_side", *(F.col("_r")[t] for t in tie)]
    carried = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = rows.withColumn("_m", F.last(F.when(F.col("_side") == 0, F.struct("_at", "_r")), True).over(carried)).filter("_side = 1")
    ends = rows.filter("_side = 0").groupBy(*keys, "_stretch").agg(F.max_by(F.struct("_at", "_r"), F.struct("_at", *(F.col("_r")[t].alias(f"_t{i}") for i, t in enumerate(tie)))).alias("_end"))
    # a stretch in which left has rows may have none of right: all stretches of a key are in the table
    known = rows.select(*keys, "_stretch").distinct().join(ends, [*keys, "_stretch"], "left")
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = known.select(*keys, "_stretch", F.last("_end", True).over(earlier).alias("_before"))
    found = inner.join(before, [*keys, "_stretch"]).withColumn("_m", F.coalesce("_m", "_before"))
    near = F.lit(True) if within is None else F.col("_at") - F.col("_m._at") <= within
    joined = found.select("_l.*", F.when(near, F.col("_m._r")).alias(matched))
    lone = left.filter(~usable).withColumn(matched, F.lit(None).cast(joined.schema[matched].dataType))
    return joined.unionByName(lone)


def overlap_join(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows whose intervals have a point in common: l and r, structs of both rows.

    Ends are whole numbers and belong to the interval; a point is an interval of equal
    ends. ``by`` are columns that have to be equal. Intervals with a null end or key, or
    that end before they begin, meet nothing; repeated rows meet each by itself.

    An interval of length n has the level of a power of two above n, or the next higher
    one of a few levels (``_chosen``), and lies in one or two bins of that width. The
    longer of two intervals is looked for in the bins of its own level that the shorter
    one touches, at most two too, so no interval is replicated by its length, only for
    each level that is left, and each pair meets in one bin: all joins are by equality of bins.
    """
    a, b = _levelled(left, left_ends, by, "l"), _levelled(right, right_ends, by, "r")
    keys = [f"_k{i}" for i in range(len(by))]
    counts = lambda df: Counter({r["_level"]: r["n"] for r in df.groupBy("_level").agg(F.count(F.lit(1)).alias("n")).collect()})
    of_a = counts(a)
    of_b = of_a if left is right and tuple(left_ends) == tuple(right_ends) else counts(b)
    levels = _chosen(of_a + of_b)
    up = {k: next(x for x in levels if x >= k) for k in of_a + of_b}
    a, b = (x.withColumn("_level", F.element_at(F.lit([up.get(k, k) for k in range(64)]), F.col("_level") + 1)) for x in (a, b))
    ups_a, ups_b = ({up[k] for k in x} for x in (of_a, of_b))
    shorter_left = _met(a, b, ups_a, ups_b, keys, "l", "r", False)
    return shorter_left.unionAll(_met(b, a, ups_b, ups_a, keys, "r", "l", True).select("l", "r"))


def point_join(points: DataFrame, ranges: DataFrame, at: str, ends: tuple[str, str], by: Sequence[str] = ()) -> DataFrame:
    """``overlap_join`` of points with intervals: l is the point's row, r the interval's."""
    return overlap_join(points, ranges, (at, at), ends, by)


def _levelled(rows: DataFrame, ends: tuple[str, str], by: Sequence[str], name: str) -> DataFrame:
    start, stop = (F.col(c).cast("bigint") for c in ends)
    usable = start.isNotNull() & stop.isNotNull() & (start <= stop)
    for k in by:
        usable = usable & F.col(k).isNotNull()
    found = rows.filter(usable).select(F.struct(*rows.columns).alias(name), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), start.alias("_a"), stop.alias("_z"))
    # a bin of 2 ** level is longer than the interval; from halves, as the length itself may not fit a long
    half = F.shiftright("_z", 1) - F.shiftright("_a", 1)
    return found.withColumn("_level", F.when(F.col("_z") == F.col("_a"), 0).otherwise(F.least(F.lit(63), F.length(F.bin(half)) + 1)).cast("int"))


def _chosen(counts: dict[int, int]) -> list[int]:
    """The fewest levels to raise intervals to, for bins in all at most WIDER times as wide as at their own levels.

    Rows of the other side are sent once for each level, so a level of few intervals is
    not worth its own; what an interval is compared with grows as the width of its bins.
    The share of each level decides, so more rows alike have the same levels.
    """
    own = sorted(counts)
    most = WIDER * sum(n << k for k, n in counts.items())
    best = {0: (0, [])}  # by how many of the levels are done: their width in all, and the levels chosen
    while own and (len(own) not in best or best[len(own)][0] > most):
        best = {j: min((w + (sum(counts[k] for k in own[i:j]) << own[j - 1]), found + [own[j - 1]]) for i, (w, found) in best.items() if i < j) for j in range(min(best) + 1, len(own) + 1)}
    return best[len(own)][1]


def _bins(level: str) -> Column:
    first, last = F.expr(f"shiftright(_a, {level})"), F.expr(f"shiftright(_z, {level})")
    return F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last))).alias("_bin")


def _met(short: DataFrame, long: DataFrame, shorts: set[int], longs: set[int], keys: list[str], s: str, l: str, strict: bool) -> DataFrame:  # noqa: E741
    """Pairs of an interval and one of the other side whose level is higher, or with not ``strict`` also equal."""
    levels = sorted(x for x in longs if shorts and (x > min(shorts) if strict else x >= min(shorts)))
    wanted = F.filter(F.lit(levels).cast("array<int>"), lambda x: x > F.col("_level") if strict else x >= F.col("_level"))
    probes = short.select(s, *keys, "_a", "_z", F.explode(wanted).alias("_at"))
    probes = probes.select(s, *keys, "_a", "_z", "_at", _bins("_at")).withColumnsRenamed({"_a": "_pa", "_z": "_pz"})
    # with no filter where all are wanted, both sides of a table with itself read one exchange
    held = (long if longs <= set(levels) else long.filter(F.col("_level").isin(levels))).select(l, *keys, "_a", "_z", F.col("_level").alias("_at"), _bins("_level"))
    met = probes.join(held, [*keys, "_at", "_bin"])
    begin = F.greatest("_a", "_pa")
    once = F.expr("shiftright(greatest(_a, _pa), _at)") == F.col("_bin")
    return met.filter((begin <= F.least("_z", "_pz")) & once).select(*(("l", "r")))
