"""SimHash near-dedup with BK-trees.

Texts become 64-bit fingerprints (each bit the majority of its shingles' hashes), equal
fingerprints become one, and fingerprints within ``max_bits`` of each other are linked.
The search uses BK-trees: a child hangs on its parent under its integer Hamming distance,
and a search follows only edges whose number is within ``max_bits`` of its distance to
the parent.

Trees are sharded, about ``SHARD`` fingerprints in each whatever their number: fingerprints
that differ in at most r bits agree in one of r + 1 runs of bits, so each is put in r + 1
shards by a few bits of each run, as few as make shards of that size (up to ``SHARD``
fingerprints: one shard). A shard of over four times that is cut again by whole runs of
the bits not yet in its key. The tree of a shard is built once. While all trees together
stay under ``TREE_BYTES``, they are broadcast and fingerprints searched where they are;
beyond that, the fingerprints of a shard and its tree are shuffled to one task. Either way
a search follows only the edges within the radius, and a task returns fewer links than
fingerprints it found, which are closed to components.

Defined cases: a null or empty text has fingerprint zero, linked like any other; rows
that repeat an id or a text are linked as copies; null ids are never a component's id
unless all its ids are null; other columns pass unchanged or aren't read; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratus.llm import tokens
from stratus.llm.common import unused, written
from stratus.llm.components import components

SEED = 42
#: Fingerprints in a shard (mean), bits of a shard that isn't cut any more, and bytes of
#: trees that are broadcast at most.
SHARD, FREE, TREE_BYTES = 2048, 16, 64 << 20
#: Rows that a task searches at once, to visit a shard's tree once for all of them.
HELD_ROWS = 1 << 20
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
LANES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """As an unsigned number. A bit is set if over half of the shingles' hashes set it."""
    from xxhash import xxh64_digest

    words = text.encode().lower().split() if text else []  # bytes.lower() changes A-Z only
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = min(shingle, len(words))
    begins = [0, *ends[: len(words) - k].tolist()]
    hashes = b"".join([xxh64_digest(body[i : j - 1], SEED) for i, j in zip(begins, ends[k - 1 :].tolist(), strict=True)])
    lanes = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8) + LANES
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(lanes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in tokens.slices(b.column(1)):
                fp = np.array([fingerprint(t, shingle) for t in b.column(1).slice(lo, hi - lo).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


class BKTree:
    """A child hangs on its parent under its Hamming distance to it, so a search that is at
    distance d of a node goes on only along edges from d - radius to d + radius. ``child``
    has a node's child for every distance (-1: none). Values are distinct."""

    def __init__(self, values: np.ndarray, parent: np.ndarray, edge: np.ndarray):
        self.values, self.parent, self.edge = values, parent, edge
        self.child = np.full((len(values), 65), -1, np.int32)
        self.child[parent[1:], edge[1:]] = np.arange(1, len(values))

    @classmethod
    def of(cls, values: np.ndarray) -> "BKTree":
        """The tree that inserting the values one by one makes, a level at a time."""
        n = len(values)
        under, parent, edge = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.uint8)
        left = np.arange(1, n)
        while len(left):
            d = np.bitwise_count(values[left] ^ values[under[left]])
            _, first, inverse = np.unique(under[left] * 65 + d, return_index=True, return_inverse=True)
            heads = left[first]  # the earliest at this place hangs there, the others go on below it
            parent[heads], edge[heads] = under[heads], d[first]
            under[left] = heads[inverse]
            left = np.delete(left, first)
        return cls(values, parent, edge)

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(query, node) of all pairs within ``radius``, and the number of nodes looked at."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        found, visits = [], 0
        while len(q):
            visits += len(q)
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            found.append((q[near], node[near]))
            edges = d[:, None] + np.arange(-radius, radius + 1)[None, :]
            after = np.where((edges >= 0) & (edges <= 64), self.child[node[:, None], np.clip(edges, 0, 64)], -1)
            at, which = np.nonzero(after >= 0)
            q, node = q[at], after[at, which].astype(np.int64)
        return *(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1)), visits

    def joined(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(a, b): links that join the queries and all values within ``radius`` of them, fewer
        than there are such values."""
        label = np.arange(len(self.values))
        for lo in range(0, len(queries), 256):
            part = queries[lo : lo + 256]
            q, node, _ = self.within(part, radius)
            own = np.full(len(part), -1)
            same = self.values[node] == part[q]
            own[q[same]] = node[same]  # queries stand in the tree themselves
            i, j = own[q], node
            while not np.array_equal(a := label[i], b := label[j]):
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))  # roots go under lesser roots
                while not np.array_equal(label, after := label[label]):
                    label = after
        apart = np.flatnonzero(label != np.arange(len(label)))
        return self.values[label[apart]], self.values[apart]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _finer(mask: int, max_bits: int, bits: int = 64) -> list[int]:
    """``mask`` with some more bits, in max_bits + 1 ways of which any two values that agree
    in ``mask`` and are within ``max_bits`` agree in one: each takes its bits, at most
    ``bits``, from another run of the free places."""
    free = [p for p in range(64) if not mask >> p & 1]
    cuts = [len(free) * i // (max_bits + 1) for i in range(max_bits + 2)]
    runs = [free[cuts[i] : cuts[i + 1]][:bits] for i in range(max_bits + 1)]
    return [mask | sum(1 << p for p in run) for run in runs if run]


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    each = [F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks]
    return fps.select("fp", F.explode(F.array(*each)).alias("k")).select("k.mask", "k.key", "fp")


def shards(distinct: DataFrame, max_bits: int = 2, shard: int = SHARD) -> DataFrame:
    """(mask, key, fp): every fingerprint in the shards it is searched in, about ``shard``
    fingerprints in the mean. One of over four times that is cut again by whole runs, until
    its free bits have no more than 2^FREE values. Any two within ``max_bits`` meet in one
    shard; shards of one are left out."""
    n = distinct.count()
    masks = [0] if n <= shard else _finer(0, max_bits, math.ceil(math.log2(n / shard)))
    keyed, out = _keyed(distinct, masks), None
    while True:
        sizes = written(keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-shards")
        widest = {r[0]: r[1] for r in sizes.groupBy("mask").agg(F.max("n")).collect()}  # a row per mask
        again = {m: n for m, n in widest.items() if n > 4 * shard and 64 - (m & _ALL).bit_count() > FREE}
        placed = keyed.join(sizes, ["mask", "key"])
        over = F.col("mask").isin(list(again)) & (F.col("n") > 4 * shard) if again else F.lit(False)
        here = placed.filter(~over).select("mask", "key", "fp")
        out = here if out is None else out.unionByName(here)
        if not again:
            return out
        parts = [_keyed(placed.filter((F.col("mask") == m) & over), _finer(m & _ALL, max_bits)) for m in again]
        keyed = written(reduce(DataFrame.unionByName, parts), "simhash-finer")


def links(distinct: DataFrame, max_bits: int = 2, shard: int = SHARD, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """(a, b): links that join all fingerprints (column fp, distinct) within ``max_bits``."""
    placed = written(shards(distinct, max_bits, shard), "simhash-placed")

    def build(key: tuple, group: pa.Table) -> pa.Table:
        t = BKTree.of(np.sort(group.column("fp").to_numpy()).view(np.uint64))
        return pa.Table.from_pylist([{"mask": key[0].as_py(), "key": key[1].as_py(), "nodes": t.values.tobytes(), "parent": t.parent.tobytes(), "edge": t.edge.tobytes()}], _TREE)

    trees = written(placed.groupBy("mask", "key").applyInArrow(build, "mask long, key long, nodes binary, parent binary, edge binary"), "simhash-trees")

    def tree(r: dict) -> BKTree:
        return BKTree(*(np.frombuffer(r[c], t) for c, t in (("nodes", np.uint64), ("parent", np.int32), ("edge", np.uint8))))

    def found(tree: BKTree, fps: np.ndarray) -> pa.RecordBatch:
        a, b = tree.joined(fps.view(np.uint64), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    size = trees.agg(F.sum(F.octet_length("nodes") + F.octet_length("parent") + F.octet_length("edge") + 100)).first()[0] or 0
    if size <= tree_bytes:
        shared = distinct.sparkSession.sparkContext.broadcast([r.asDict() for r in trees.collect()])  # at most tree_bytes

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = {(r["mask"], r["key"]): r for r in shared.value}
            held, size = [], 0
            for b in batches:
                held.append(np.stack([c.to_numpy() for c in b.columns], 1))
                size += len(held[-1])
                if size >= HELD_ROWS:
                    yield from searched(rows, np.concatenate(held))
                    held, size = [], 0
            if size:
                yield from searched(rows, np.concatenate(held))

        def searched(rows: dict, some: np.ndarray) -> Iterator[pa.RecordBatch]:
            some = some[np.lexsort((some[:, 1], some[:, 0]))]
            begins = np.flatnonzero(np.r_[True, (some[1:, :2] != some[:-1, :2]).any(axis=1)]).tolist()
            for lo, hi in zip(begins, [*begins[1:], len(some)], strict=True):
                yield found(tree(rows[tuple(some[lo, :2].tolist())]), np.ascontiguousarray(some[lo:hi, 2]))

        return placed.mapInArrow(search, "a long, b long")

    # trees beyond that meet their queries where both are shuffled to
    def meet(one: pa.Table, some: pa.Table) -> pa.Table:
        return pa.Table.from_batches([found(tree(one.to_pylist()[0]), some.column("fp").to_numpy())])

    return trees.groupBy("mask", "key").cogroup(placed.groupBy("mask", "key")).applyInArrow(meet, "a long, b long")


_ALL = (1 << 64) - 1
_TREE = pa.schema([("mask", pa.int64()), ("key", pa.int64()), *[(c, pa.binary()) for c in ("nodes", "parent", "edge")]])


def _classes(fps: DataFrame, id_col: str, max_bits: int, shard: int) -> DataFrame:
    """(f, top, component_id): for each fingerprint its class and the class's least id."""
    reps = written(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    roots = written(components(links(reps.select("fp"), max_bits, shard)), "fingerprint-roots")
    member = reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("top"))
    ids = member.groupBy(F.col("top").alias("t")).agg(F.min("least").alias("component_id"))
    return written(member.join(ids, F.col("top") == F.col("t")).select(F.col("fp").alias("f"), "top", "component_id"), "fingerprint-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, shard: int = SHARD) -> DataFrame:
    """A row per row of ``docs``: the id, fp (signed long) and component_id, the smallest
    id that links reach."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return fps.join(_classes(fps, id_col, max_bits, shard), F.col("fp") == F.col("f")).select(id_col, "fp", "component_id")


def _digest(text: Column) -> Column:
    """128 bits of a text; none for null."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, shard: int = SHARD) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the least
    id stays (null ids last; of rows with that id, one of them). A row is known by its id
    together with its text's digest."""
    row, nth = unused("row", docs), unused("nth", docs)
    keyed = docs.withColumn(row, _digest(F.col(f"`{text_col}`")))
    who = keyed.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.col(row).alias("row")).alias("who"), F.col(f"`{text_col}`").alias("text"))
    fps = written(fingerprints(who, "who", "text", shingle).select("who.*", "fp"), "fingerprints")
    best = fps.join(_classes(fps, "id", max_bits, shard), F.col("fp") == F.col("f")).groupBy("top").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best"))
    stay = best.select(F.col("best.id").alias("stay_id"), F.col("best.row").alias("stay_row"))
    names = [f"c{i}" for i in range(len(keyed.columns))]  # the result has the names; here they are numbers
    own_id, own_row = names[docs.columns.index(id_col)], names[-1]
    kept = keyed.toDF(*names).join(stay, F.col(own_id).eqNullSafe(F.col("stay_id")) & (F.col(own_row) == F.col("stay_row")))
    kept = kept.withColumn(nth, F.row_number().over(Window.partitionBy(own_id, own_row).orderBy(own_row))).filter(F.col(nth) == 1)
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def query(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
