"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles; two link at a Jaccard similarity of 0.75 or
more. The join is exact:

1. Shingles are counted over all documents. One that only a single text has can't
   be shared, so a text with too few others can't link with anything and leaves.
2. Of each remaining set the rarest tokens are its prefix. Two sets that link have a
   prefix token in common, whichever they are.
3. Similar sets are put in groups by smallest hashes. A set is held against the
   connected parts of its group until one member of a part links.
4. The matrix says which groups hold a token in a member's prefix. For a set and a
   group that aren't connected yet and meet in it, the group's stored token union
   bounds the overlap, and only a group that passes the bound is opened. The first
   member that links connects the set with the whole group, so it is closed again.

Groups are blocks of bounded size, and queries of a group are split the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automata import word_hashes
from .common import ascii_lower, cut, read_table, stored, tidy
from .components import components
from .passages import NO_ID, keyed, mix, two_longs

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Bytes of text whose shingles are counted together before they are shuffled.
CHUNK_BYTES = 4 << 20
#: Bytes of text for each bucket of the shingle count: about a million shingles.
BUCKET_BYTES = 6 << 20
#: Steps of rarity in an octave of counts: shingles of one passage have one count, so with fine steps a prefix
#: holds few passages. A rank of sixteen bits reaches counts of 2 ** 32.
STEPS = 2000
#: Sets in a group, and queries that one task holds against it.
GROUP = 64
#: Texts of more rows than these, and than one row in HOT_TEXTS, are hot: at most so many, so their table is broadcast.
HOT_ROWS, HOT_TEXTS = 1000, 100_000


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; with fewer words, of all of them."""
    words = ascii_lower(text).split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    if len(h) < size:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64)
    out = h[: len(h) - size + 1]
    for i in range(1, size):
        out = mix(out, h[i : len(h) - size + 1 + i])
    return np.unique(out)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets link."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def _tokens(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop texts that this task has passed on already."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keys = list(zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), strict=True))
        take = []
        for i, k in enumerate(keys):
            if k not in seen:
                seen.add(k)
                take.append(i)
        yield batch.take(pa.array(take, pa.int64()))


def _cooled(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """Without the rows of hot texts but those of the smallest id: else every task would send one copy to the same one.

    ``firsts`` has each text's smallest id and rows.
    """
    total = firsts.agg(F.sum("copies")).first()[0] or 0
    hot = firsts.filter(F.col("copies") > max(HOT_ROWS, total // HOT_TEXTS)).select("d1", "d2", F.col("doc").alias("first"))
    return rows.join(F.broadcast(hot), ["d1", "d2"], "left").filter("first IS NULL OR first = doc").drop("first")


def _distinct_sets(table: pa.Table, size: int) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    texts = dict(zip(zip(table["d1"].to_pylist(), table["d2"].to_pylist(), strict=True), table["text"], strict=True))
    keys = sorted(texts)
    return keys, [shingle_set(texts[k].as_py().encode(), size) for k in keys]


def _need(n: int, percent: int) -> int:
    """The least intersection that a set of n shares with one it links with."""
    return -(-percent * n // 100)


def shingle_sets(rows: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """For each distinct text: d1, d2, n, s1, s2 (its set's digest), tokens, prefix, rests.

    tokens (sorted), prefix and rests are null where the set can't link with another.
    ``rests`` says for each token of the prefix how many of the set it and those after
    it in the order of rarity are.
    """
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, total // CHUNK_BYTES)
    bits = max(0, (total // BUCKET_BYTES).bit_length())
    low = np.uint64(32 - bits)
    mask = np.uint64(0xFFFFFFFF)

    def short(tokens: np.ndarray) -> np.ndarray:
        """Bucket and 32 bits: a collision only makes a token look shared."""
        return tokens >> low

    def count(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        _, sets = _distinct_sets(table, size)
        names, counts = np.unique(short(np.concatenate(sets)) if sets else np.empty(0, np.uint64), return_counts=True)
        buckets = (names >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(buckets)) + 1
        out: list[list] = [[], [], []]
        for part, n in zip(np.split(names, cuts), np.split(counts, cuts), strict=True):
            if len(part):
                out[0].append(int(part[0] >> np.uint64(32)))
                out[1].append((part & mask).astype(np.uint32).tobytes())
                out[2].append(np.minimum(n, 255).astype(np.uint8).tobytes())
        tidy()
        return pa.table({"bucket": pa.array(out[0], pa.int32()), "chunk": pa.array([chunk] * len(out[0]), pa.int32()), "names": pa.array(out[1], pa.binary()), "counts": pa.array(out[2], pa.binary())})

    def shared(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint32) for x in table["names"]]
        names = np.concatenate(parts)
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table["counts"]]).astype(np.int64)
        order = np.argsort(names, kind="stable")
        ordered = names[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        sums = np.add.reduceat(counts[order], starts)
        rank = np.zeros(len(names), np.uint16)
        rank[order] = np.repeat(np.where(sums > 1, (STEPS * np.log2(np.maximum(sums, 1))).astype(np.uint16) + 1, 0).astype(np.uint16), np.diff(np.concatenate([starts, [len(names)]])))
        out: list[list] = [[], [], [], []]
        at = 0
        for chunk, part in zip(table["chunk"].to_pylist(), parts, strict=True):
            r = rank[at : at + len(part)]
            at += len(part)
            keep = r > 0
            if keep.any():
                for column, v in zip(out, (chunk, table["bucket"][0].as_py(), part[keep].tobytes(), r[keep].tobytes()), strict=True):
                    column.append(v)
        return pa.table({"chunk": pa.array(out[0], pa.int32()), "bucket": pa.array(out[1], pa.int32()), "names": pa.array(out[2], pa.binary()), "ranks": pa.array(out[3], pa.binary())})

    def choose(table: pa.Table, live: pa.Table) -> pa.Table:
        keys, sets = _distinct_sets(table, size)
        live = live.sort_by("bucket")
        parts = [np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) | (np.uint64(b) << np.uint64(32)) for b, x in zip(live["bucket"].to_pylist(), live["names"], strict=True)]
        names = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        ranks = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in live["ranks"]]) if parts else np.empty(0, np.uint16)
        out: list[list] = [[], [], [], [], [], [], [], []]
        for (d1, d2), tokens in zip(keys, sets, strict=True):
            n, prefix, rests = len(tokens), None, None
            s1, s2 = two_longs(tokens.tobytes())
            if n and len(names):
                at = np.searchsorted(names, short(tokens))
                at[at == len(names)] = 0
                rank = np.where(names[at] == short(tokens), ranks[at], 0)
                if 100 * np.count_nonzero(rank) >= percent * n:
                    first = np.lexsort((tokens, rank))[: n - _need(n, percent) + 1]
                    at = np.flatnonzero(rank[first] > 0)
                    prefix, rests = tokens[first][at].view(np.int64), n - at
            for column, v in zip(out, (d1, d2, n, s1, s2, None if prefix is None else tokens.tobytes(), prefix, rests), strict=True):
                column.append(v)
        tidy()
        kinds = [pa.int64()] * 5 + [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table({c: pa.array(v, k) for c, v, k in zip(("d1", "d2", "n", "s1", "s2", "tokens", "prefix", "rests"), out, kinds, strict=True)})

    texts = rows.select("d1", "d2", "text").mapInArrow(_once, "d1 bigint, d2 bigint, text string")
    texts = texts.withColumn("chunk", F.pmod(F.col("d1"), F.lit(chunks)).cast("int"))
    counted = texts.groupBy("chunk").applyInArrow(count, "bucket int, chunk int, names binary, counts binary")
    live = counted.groupBy("bucket").applyInArrow(shared, "chunk int, bucket int, names binary, ranks binary")
    out = texts.groupBy("chunk").cogroup(live.groupBy("chunk")).applyInArrow(choose, "d1 bigint, d2 bigint, n bigint, s1 bigint, s2 bigint, tokens binary, prefix array<bigint>, rests array<bigint>")
    return stored(out)


def _smallest(tokens: np.ndarray, seed: int) -> int:
    return int(mix(tokens, np.full(1, seed, np.uint64)).min().view(np.int64))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set once for each of two smallest hashes."""
    for batch in batches:
        for seed in (1, 2):
            sign = [_smallest(_tokens(t.as_py()), seed) for t in batch.column("tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("tokens"), pa.array(sign, pa.int64())], ["node", "tokens", "sign"])


def group_edges(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) that connect what is linked within a group.

    Sets with one smallest hash are dealt out to groups, and the first of them joins
    each group, so that large families hold together.
    """
    signed = sets.select("node", "tokens").mapInArrow(_signed, "node bigint, tokens binary, sign bigint")
    sizes = cut(signed.groupBy("sign").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).filter("n > 1"))
    blocks = F.ceil(F.col("n") / GROUP).cast("int")
    members = signed.join(sizes, "sign")
    placed = members.withColumn("block", F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), blocks).cast("int"))))
    placed = placed.select("sign", F.explode("block").alias("block"), "node", "tokens")

    def inside(table: pa.Table) -> pa.Table:
        """A tree of edges for each connected part of the block, member by member."""
        rows = dict(zip(table["node"].to_pylist(), table["tokens"], strict=True))
        nodes = sorted(rows)
        tokens = [_tokens(rows[x].as_py()) for x in nodes]
        parts_: list[list[int]] = []
        a, b = [], []
        for i in range(len(nodes)):
            joined: list[int] = []
            rest = []
            for part in parts_:
                j = next((j for j in part if linked(tokens[i], tokens[j], percent)), None)
                if j is None:
                    rest.append(part)
                else:
                    joined += part
                    a.append(nodes[i])
                    b.append(nodes[j])
            parts_ = [*rest, [*joined, i]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return placed.groupBy("sign", "block").applyInArrow(inside, "a bigint, b bigint")


def _met(grouped: DataFrame, percent: int) -> DataFrame:
    """The matrix: which sets meet which groups in a prefix token (node, label, block).

    A token of very many sets is split by classes of size and of place in the prefix, a
    few hundred at most, and only classes that can hold sets that link are joined.
    """
    each = grouped.select("node", "n", "label", "block", F.inline(F.arrays_zip("prefix", "rests"))).withColumnsRenamed({"prefix": "token", "rests": "rest"})
    two = each.groupBy("token").agg(F.min("label").alias("la"), F.max("label").alias("lb")).filter("la <> lb").select("token")
    size, place = F.floor(F.log(F.col("n")) / F.log(F.lit(1.05))).cast("int"), F.floor((F.col("n") - F.col("rest")) * 20 / F.col("n")).cast("int")
    each = each.join(two, "token").withColumn("s", size).withColumn("p", place)
    classes = each.groupBy("token", "s", "p").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"), F.min("label").alias("la"), F.max("label").alias("lb"))
    mine = classes.toDF("token", "s", "p", "n", "qmost", "qrest", "qla", "qlb")
    theirs = classes.withColumnsRenamed({"s": "ts", "p": "tp"})
    # at the first token that two sets have in common, what follows must suffice
    enough = (100 + percent) * F.least("qrest", "rest") >= percent * (F.col("n") + F.col("least"))
    sized = (100 * F.col("qmost") >= percent * F.col("least")) & (100 * F.col("most") >= percent * F.col("n"))
    pairs = mine.join(theirs, "token").filter(enough & sized & (F.col("qla") < F.col("lb"))).select("token", "s", "p", "ts", "tp")
    matrix = each.groupBy("token", "s", "p", "label", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest")).withColumnsRenamed({"s": "ts", "p": "tp"})
    asks = each.select("token", "s", "p", "node", "n", F.col("n").alias("qmost"), F.col("label").alias("ql"), F.col("rest").alias("qrest"))
    met = asks.join(pairs, ["token", "s", "p"]).join(matrix, ["token", "ts", "tp"]).filter((F.col("ql") < F.col("label")) & sized & enough)
    return met.select("node", "label", "block").distinct()


def _overlapping(percent: int):
    """Of the queries of one group those whose overlap with its union reaches the bound."""

    def run(table: pa.Table) -> pa.Table:
        query = table["query"].to_numpy()
        at = int(np.flatnonzero(~query)[0])
        union, least = _tokens(table["tokens"][at].as_py()), table["least"][at].as_py()
        keep = []
        for i in np.flatnonzero(query).tolist():
            tokens = _tokens(table["tokens"][i].as_py())
            both = overlap(tokens, union)
            if 100 * both >= percent * len(tokens) and (100 + percent) * both >= percent * (len(tokens) + least):
                keep.append(i)
        return table.select(["node", "label", "block", "part"]).take(pa.array(keep, pa.int64()))

    return run


def _opened(percent: int):
    """Edges from queries to the first member of their group that they link with."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["query"].to_pylist(), table["node"].to_pylist(), (_tokens(t.as_py()) for t in table["tokens"]), strict=True), key=lambda x: x[:2])
        members = [(node, tokens) for query, node, tokens in rows if not query]
        a, b = [], []
        for query, node, tokens in rows:
            other = next((m for m, theirs in members if linked(tokens, theirs, percent)), None) if query else None
            if other is not None:
                a.append(node)
                b.append(other)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def cross_edges(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges between connected groups: ``sets`` has node, n, tokens, prefix, rests, label.

    The unions of all groups that are met are stored, each query is held against the
    union, and only where that bound is reached are the group's members sent and opened.
    """
    label_n = sets.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    grouped = sets.select("node", "n", "prefix", "rests", "label").join(label_n, "label")
    grouped = grouped.withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / GROUP)).cast("int"))
    met = cut(_met(grouped, percent))
    queries = cut(met.groupBy("label", "block").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts")))
    tokens = sets.select("node", "n", "tokens")
    members = grouped.select("node", "label", "block").join(queries.select("label", "block"), ["label", "block"]).join(tokens, "node")

    def unite(table: pa.Table) -> pa.Table:
        union = np.unique(np.concatenate([_tokens(t.as_py()) for t in table["tokens"]]))
        return pa.table({"label": table["label"][:1], "block": table["block"][:1], "least": pa.array([min(table["n"].to_pylist())], pa.int64()), "tokens": pa.array([union.tobytes()], pa.binary())})

    unions = stored(members.groupBy("label", "block").applyInArrow(unite, "label bigint, block int, least bigint, tokens binary"))
    part = F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part")
    bound = unions.join(queries, ["label", "block"]).select(F.lit(None).cast("bigint").alias("node"), "label", "block", part, F.lit(False).alias("query"), "least", "tokens")
    asked = met.join(queries, ["label", "block"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(tokens.drop("n"), "node")
    asked = asked.select("node", "label", "block", "part", F.lit(True).alias("query"), F.lit(None).cast("bigint").alias("least"), "tokens")
    fit = cut(bound.unionAll(asked).groupBy("label", "block", "part").applyInArrow(_overlapping(percent), "node bigint, label bigint, block int, part int"))
    doors = fit.select("label", "block", "part").distinct()
    opened = members.select("node", "label", "block", "tokens").join(doors, ["label", "block"]).select("node", "label", "block", "part", F.lit(False).alias("query"), "tokens")
    asking = fit.join(tokens.drop("n"), "node").select("node", "label", "block", "part", F.lit(True).alias("query"), "tokens")
    return opened.unionAll(asking).groupBy("label", "block", "part").applyInArrow(_opened(percent), "a bigint, b bigint")


def text_components(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """For each distinct text of ``rows``: d1, d2, n and least, the (doc, d1, d2) of the
    smallest id that links lead to; null where the text has no shingle. Only keys, no
    texts, are joined."""
    firsts = cut(rows.groupBy("d1", "d2").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies")))
    texts = shingle_sets(_cooled(rows.select("doc", "d1", "d2", "text"), firsts), size, percent)
    sets = texts.filter("tokens IS NOT NULL").groupBy(F.col("s1").alias("node"), "s2").agg(F.first(F.struct("n", "tokens", "prefix", "rests")).alias("x")).select("node", "x.*")
    sets = stored(sets)
    near = cut(components(group_edges(sets, percent)))
    labelled = sets.join(near, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    far = cut(cross_edges(labelled, percent))
    named = far.join(near.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(near.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    joined = components(named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    joined = joined.select(F.col("node").alias("label"), F.col("component").alias("root"))
    each = texts.select("d1", "d2", "n", "s1").join(near.withColumnRenamed("node", "s1"), "s1", "left").withColumn("label", F.coalesce("component", "s1")).join(joined, "label", "left")
    each = each.select("d1", "d2", "n", F.coalesce("root", "label").alias("c")).join(firsts.drop("copies"), ["d1", "d2"])
    each = cut(each)
    least = cut(each.filter("n > 0").groupBy("c").agg(F.min(F.struct("doc", "d1", "d2")).alias("least")))  # so that a hot component's side of the join can be split
    some = each.filter("n > 0").join(least, "c").select("d1", "d2", "n", "least")
    return some.unionByName(each.filter("n = 0").select("d1", "d2", "n").withColumn("least", F.lit(None).cast("struct<doc:bigint,d1:bigint,d2:bigint>")))


def join_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, text: str = "text", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """Each document's ``row`` (the ``carry`` columns), n_shingles and component_id.

    component_id is the smallest id that links lead to, its own included. Null and
    empty texts have no shingle and link with nothing; equal texts, and texts whose
    sets are equal, link. A null id is larger than all others and null again where it
    is the smallest. Repeated rows are in one component. Texts are whole, however long:
    one task makes a text's set, and a long text of one repeated unit is a small set.
    Other columns may have any names: they travel inside ``row``.
    """
    rows = keyed(docs, text, id_col, docs.columns if carry is None else carry)
    found = rows.select("row", "doc", "d1", "d2").join(text_components(rows, size, percent), ["d1", "d2"])
    least = F.coalesce("least.doc", "doc")
    return found.select("row", F.col("n").alias("n_shingles"), F.when(least < NO_ID, least).alias("component_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Of each group of linked documents the one with the smallest id, all its columns.

    Of rows that have that id the one with the smallest text hash stays, and one of
    equal rows. Documents without a word stay, and so do documents without an id that
    link with none that has one.
    """
    rows = keyed(docs, text, id_col, docs.columns).select("row", "doc", "text", "d1", "d2")
    found = cut(text_components(rows, size, percent))
    chosen = found.filter("n > 0").select("least.*").filter(F.col("doc") < NO_ID).distinct()
    places = rows.select("row", "doc", "d1", "d2")
    kept = places.join(chosen, ["doc", "d1", "d2"]).groupBy("doc", "d1", "d2").agg(F.first("row").alias("row")).select("row")
    blank = rows.filter(~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("row")
    nameless = places.filter(F.col("doc") == NO_ID).join(found.filter(F.col("least.doc") == NO_ID).select("d1", "d2"), ["d1", "d2"]).select("row")
    return kept.unionAll(blank).unionAll(nameless).select("row.*")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(read_table(spark, sf_dir, "documents"), carry=["doc_id"]).select("row.doc_id", "n_shingles", "component_id")
