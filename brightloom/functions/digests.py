"""Digests of sets of files that no single task has to gather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a member's digest that name its cell.
CELL_DIGITS = 3


def member(*fields: Column) -> Column:
    """One digest for the fields of a member: each field's own digest has a fixed width,
    so no two lists of fields run together."""
    return F.sha2(F.concat(*(F.sha2(f, 256) for f in fields)), 256)


def cell(digest: str) -> Column:
    """The name of the cell that a member's digest is dealt to."""
    return F.substring(digest, 1, CELL_DIGITS)


def cells(members: DataFrame, by: str, digest: str = "member") -> DataFrame:
    """(by, cell, inner): the digest of each cell's sorted members."""
    return members.groupBy(by, cell(digest).alias("cell")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(digest)), ""), 256).alias("inner"))


def tree(members: DataFrame, by: str, digest: str = "member") -> DataFrame:
    """(by, digest): a digest of all members' digests, whatever their order.

    A tree of two levels: members are dealt to cells by their digests, a cell's digest is
    of its sorted members, and the whole is of its sorted cells. A task holds one cell.
    """
    return top(cells(members, by, digest), by)


def top(found: DataFrame, by: str) -> DataFrame:
    """(by, digest) of cells."""
    return found.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("cell", "inner"))), ""), 256).alias("digest"))
