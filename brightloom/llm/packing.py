"""Best-fit packing of tokenized documents by hierarchical residual packing.

Partitions best-fit their items locally. Bins that are nearly full are emitted;
underfull bins become the items of the next round, over fewer partitions, until
one partition has held all that is left or a round no longer joins any.
"""

from __future__ import annotations

import array
import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, named, read_table, tidy

CAPACITY = 2048
#: A bin that has at most so many tokens left is nearly full.
SLACK = 16
#: Items or bins that one task packs.
ITEMS_PER_TASK = 60_000
#: Words whose ids a worker keeps in each of two generations.
WORDS_KEPT = 150_000
MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"

#: Characters whose case and class don't depend on context or Unicode version.
_PLAIN = [chr(c) for c in range(0x180) if c != 0x130]
_LETTERS, _NUMBERS = ("".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind) for kind in "LN")
_SPACES = "\t-\r \x85\xa0"
#: The tokenizer's own splitting, for plain characters.
_SPLIT = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
_NOT_PLAIN = "[^\x00-\u012f\u0131-\u017f]"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next from 256."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(other)) for b in range(256)]


class WordIds(dict):
    """Ids of the tokenizer's words, as packed unsigned 32-bit numbers.

    Texts of plain characters are lower-cased and split here, and only words not
    seen lately reach the model; any other text, and one that holds the string of an
    added token, goes to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.old = self.tokenizer.model, _byte_letters(), {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([_NOT_PLAIN, *map(re.escape, added)]))

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            shown = word if word.isascii() and word.isprintable() else "".join(self.letters[b] for b in word.encode())
            ids = array.array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(self) >= WORDS_KEPT:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if self.whole.search(text):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, _SPLIT.findall(text.lower())))


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for each worker process: what it has learned serves its later tasks."""
    return WordIds(path)


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32.

    Every document ends with ``end_id``; null text is empty, so it is one piece of
    one id. Null and repeated ids pass through. ``with_ids`` adds the ids
    themselves, as little-endian unsigned 32-bit words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, end = word_ids(path), array.array("I", [end_id]).tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.of(t.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, v in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                        column.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)][: 6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])
        tidy()

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select(named(id_col).cast("bigint").alias("doc_id"), named(text).alias("text")).mapInArrow(run, schema)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item numbers.

    ``free`` has a bit for each remaining capacity that some bin has, so the bin
    that fits best is one shift and one lowest bit away.
    """
    bins: list[list[int]] = []
    with_left: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = with_left[left].pop()
            if not with_left[left]:
                free &= ~(1 << left)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        left -= size
        if left:
            with_left[left].append(b)
            free |= 1 << left
    return bins


def _pack_partition(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.combine_chunks()
        totals = table.column("total").to_pylist()
        lists = table.column("members").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offsets, values = lists.offsets.to_numpy(), lists.values
        bins = best_fit(totals, capacity)
        order = [i for b in bins for i in b]
        take = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in order])
        ends = np.cumsum([sum(int(offsets[i + 1] - offsets[i]) for i in b) for b in bins])
        packed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values.take(pa.array(take)))
        yield pa.RecordBatch.from_arrays([pa.array([sum(totals[i] for i in b) for b in bins], pa.int64()), packed], ["total", "members"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """Place pieces in sequences: adds sequence_id and offset (gapless from 0).

    ``pieces`` has doc_id, piece, start, length (1 to ``capacity``) and ids_crc32.
    No task ever holds more than ITEMS_PER_TASK items, however many are left. An
    empty table gives an empty table; repeated rows are packed each by itself.
    """
    spark = pieces.sparkSession
    bins = pieces.select(F.col("length").alias("total"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32").cast(MEMBER)).alias("members"))
    done = bins.filter(F.col("total") >= capacity - slack)
    open_ = bins.filter(F.col("total") < capacity - slack)
    n = open_.count()
    while n:
        wide = -(-n // ITEMS_PER_TASK)
        merged = cut(open_.repartition(wide).mapInArrow(_pack_partition(capacity), f"total bigint, members array<{MEMBER}>"))
        done = done.unionAll(merged.filter(F.col("total") >= capacity - slack))
        open_ = merged.filter(F.col("total") < capacity - slack)
        left = open_.count()
        if wide == 1 or left == n:
            break
        n = left
    if n:
        done = done.unionAll(open_)
    numbered = done.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    starts = F.aggregate(
        "members",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<struct<at:bigint,m:{MEMBER}>>").alias("out")),
        lambda acc, m: F.struct((acc["at"] + m["length"]).alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("at"), m.alias("m"))).alias("out")),
        lambda acc: acc["out"],
    )
    placed = numbered.select("sequence_id", F.inline(starts).alias("offset", "m"))
    return placed.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "offset")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize and pack documents; see ``tokenize`` and ``pack``."""
    return pack(cut(tokenize(docs, path or tokenizer_path(), capacity)), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
