"""Near-duplicate vectors by an inverted multi-index.

Each half of a vector is quantised by a codebook of its own; the pairs of codewords form a
grid of cells. A vector is a resident of its nearest cell and visits further cells in the
order of their distance (the multi-sequence order: the sum of the two halves' distances)
up to an excess over the nearest cell. The excess is calibrated for ``recall``: of
neighbours at exactly the least cosine, drawn around vectors of the sample, that share
must lie in a visited cell of either. Vectors that meet in a cell are verified in double
precision, so no link is false.

Codebooks and excess are fitted in one task on a sample of at most about ``MAX_SAMPLE``
vectors; every vector is indexed. The codebooks' size follows the root of the number of
vectors of the largest label and ends at ``MAX_CODES``, which bounds what is broadcast.

Equal vectors of a label are one before the search. A cell with more members than
``BLOCK`` is cut into blocks and every two blocks meet in a group of their own, so a cell
that a third of all vectors share is spread over many tasks and none holds more than two
blocks. A group returns a row for each linked member: how many it is linked to, and the
least it is joined to there; never the pairs.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components,
and one without a label link with nothing; each length that occurs has an index of its own;
rows that repeat an id are vectors of their own; null ids are never a component's id
unless all its ids are null; other columns aren't read; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratus.llm.common import written
from stratus.llm.components import components

MAX_SAMPLE, MAX_CODES = 20_000, 1024
#: Vectors of a label in a cell, about, and members of a block.
CELL_ROWS, BLOCK = 32, 256
ROUNDS = 12


# ---- the index --------------------------------------------------------------------------


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length, in double precision; scaled first, so that none overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codebook(x: np.ndarray, codes: int, draw: np.random.Generator) -> np.ndarray:
    """Lloyd's k-means; a codeword that no vector is nearest to stays where it is."""
    c = x[draw.choice(len(x), min(codes, len(x)), replace=False)]
    for _ in range(ROUNDS):
        nearest = _squares(x, c).argmin(1)
        n = np.bincount(nearest, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


class MultiIndex:
    def __init__(self, first: np.ndarray, second: np.ndarray, excess: float):
        self.first, self.second, self.excess, self.half = first, second, excess, first.shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squares(x[:, : self.half], self.first), _squares(x[:, self.half :], self.second)

    def home(self, d: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return d[0].argmin(1) * len(self.second) + d[1].argmin(1)

    def visits(self, d1: np.ndarray, d2: np.ndarray) -> list[int]:
        """Cells in multi-sequence order up to the excess, the nearest first."""
        (o1, s1), (o2, s2) = self._within(d1), self._within(d2)
        found, todo, width = [], [(0.0, 0, 0)], len(self.second)
        while todo:  # each cell is entered once: along its row, or down the first column
            total, i, j = heappop(todo)
            found.append(o1[i] * width + o2[j])
            if j + 1 < len(o2) and s1[i] + s2[j + 1] <= self.excess:
                heappush(todo, (s1[i] + s2[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(o1):
                heappush(todo, (s1[i + 1], i + 1, 0))
        return found

    def _within(self, d: np.ndarray) -> tuple[list[int], list[float]]:
        """Codewords by distance, and their excess over the nearest, up to the limit."""
        over = d - d.min()
        some = np.flatnonzero(over <= self.excess)
        order = some[np.argsort(over[some], kind="stable")]
        return order.tolist(), over[order].tolist()

    @staticmethod
    def fitted(sample: np.ndarray, codes: int, least: float, recall: float) -> "MultiIndex":
        draw = np.random.default_rng(5)
        half = max(1, sample.shape[1] // 2)
        index = MultiIndex(codebook(sample[:, :half], codes, draw), codebook(sample[:, half:], codes, draw), 0.0)
        x = sample[draw.choice(len(sample), min(4000, len(sample)), replace=False)]
        side = draw.normal(size=x.shape)
        side -= (side * x).sum(1, keepdims=True) * x
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
        y = least * x + np.sqrt(1 - least * least) * side
        dx, dy = index.distances(x), index.distances(y)

        def beyond(d, other):
            rows = np.arange(len(x))
            return sum(a[rows, b.argmin(1)] - a.min(1) for a, b in zip(d, other, strict=True))

        index.excess = float(np.quantile(np.minimum(beyond(dx, dy), beyond(dy, dx)), recall)) + 1e-9
        return index


def fit(reps: DataFrame, least: float, recall: float, max_sample: int) -> MultiIndex | None:
    """From about ``max_sample`` of the vectors (vector, label; of one length) at most, by a
    hash."""
    seen = reps.groupBy("label").count().agg(F.sum("count"), F.max("count")).first()
    if not seen[0]:
        return None
    share = min(1.0, max_sample / seen[0])
    codes = int(min(MAX_CODES, max(1, np.sqrt(seen[1] / CELL_ROWS))))  # the largest label's cells have CELL_ROWS
    picked = written(reps.filter(F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).select("vector"), "vector-sample")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.asarray(v, dtype=np.float64) for b in batches for v in b.column(0).to_pylist()]
        if not rows:
            return
        x = np.stack(rows)
        m = MultiIndex.fitted(unit(x[np.lexsort(x.T)]), codes, least, recall)
        yield pa.RecordBatch.from_arrays([pa.array([m.first.tobytes()]), pa.array([m.second.tobytes()]), pa.array([len(m.first)]), pa.array([m.excess])], names=["first", "second", "codes", "excess"])

    got = picked.coalesce(1).mapInArrow(learn, "first binary, second binary, codes long, excess double").first()  # of bounded size
    return got and MultiIndex(np.frombuffer(got["first"]).reshape(got["codes"], -1), np.frombuffer(got["second"]).reshape(got["codes"], -1), got["excess"])


# ---- search and verification ------------------------------------------------------------


def usable(vector: str, label: str) -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(label).isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def members(reps: DataFrame, index: MultiIndex) -> DataFrame:
    """A row for each cell that a vector is in: label, cell, home, visits, node, n, vector."""
    shared = reps.sparkSession.sparkContext.broadcast((index.first, index.second, index.excess))
    kind = reps.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = MultiIndex(*shared.value)
        width = m.first.shape[1] + m.second.shape[1]
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                x = part.column(part.schema.get_field_index("vector")).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                d = m.distances(unit(x))
                home = m.home(d)
                visits = [m.visits(p, q) for p, q in zip(*d, strict=True)]
                row = np.repeat(np.arange(len(x)), [len(v) for v in visits])
                take = pa.array(row)
                cols = {
                    "label": part.column(part.schema.get_field_index("label")).take(take),
                    "cell": pa.array(np.concatenate(visits).astype(np.int64)),
                    "home": pa.array(home[row].astype(np.int64)),
                    "visits": pa.array([visits[i] for i in row], pa.list_(pa.int64())),
                    "node": part.column(part.schema.get_field_index("node")).take(take),
                    "n": part.column(part.schema.get_field_index("n")).take(take),
                    "vector": pa.array([x[i].tobytes() for i in row], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(cols)

    return reps.select("label", "node", "n", "vector").mapInArrow(run, f"label {kind}, cell long, home long, visits array<long>, node long, n long, vector binary")


LINKED = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def verified(table: pa.Table, least: float) -> pa.Table:
    """Links between the members of a group: of one block, or across its two blocks. A pair
    that meets in two cells counts in the one of the smaller number."""
    if table.num_rows < 2:
        return LINKED.empty_table()
    x = unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(table.num_rows, -1))
    node, n, home, block = (table.column(c).to_numpy() for c in ("node", "n", "home", "block"))
    cell, two = table.column("cell")[0].as_py(), len(np.unique(block)) > 1
    near = x @ x.T >= least
    resident = home == cell
    near &= resident[:, None] | resident[None, :]
    if two:
        near &= block[:, None] != block[None, :]
    elif table.column("first")[0].as_py() != table.column("second")[0].as_py():
        near[:] = False  # one of the two blocks is empty
    np.fill_diagonal(near, False)
    i, j = np.nonzero(near & ~resident[:, None])  # i visits, j resides
    visits = table.column("visits").to_pylist() if len(i) else []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if home[a] < cell and int(home[a]) in visits[b]:
            near[a, b] = near[b, a] = False
    linked = np.flatnonzero(near.any(1))
    if not len(linked):
        return LINKED.empty_table()
    near, ids = near[np.ix_(linked, linked)], node[linked]
    root, last = ids.copy(), None
    while last is None or (root != last).any():
        last = root
        root = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(1))
    return pa.Table.from_arrays([pa.array(ids), pa.array(root), pa.array(near @ n[linked])], schema=LINKED)


def _linked(reps: DataFrame, least: float, recall: float, max_sample: int) -> DataFrame:
    """(node, root, links) of the linked vectors of one length, by group."""
    # a hash sample of a rare length can be empty: then all its vectors are the sample
    index = fit(reps, least, recall, max_sample) or fit(reps, least, recall, 1 << 62)
    inside = members(reps, index)
    sizes = inside.groupBy("label", "cell").count().filter(F.col("count") > BLOCK)
    sizes = written(sizes.select(F.col("label").alias("__l"), F.col("cell").alias("__c"), F.ceil(F.col("count") / BLOCK).alias("blocks")), "hot-cells")
    x = inside.join(sizes, (F.col("label") == F.col("__l")) & (F.col("cell") == F.col("__c")), "left")
    x = x.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    groups = x.select("label", "cell", "first", "second", "block", "home", "visits", "node", "n", "vector").groupBy("label", "cell", "first", "second")
    return written(groups.applyInArrow(lambda t: verified(t, least), "node long, root long, links long"), "vector-links")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, recall: float = 0.99, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """A row per row of ``rows``: the id, n_links, component_id and kept."""
    all_rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("l")).withColumn("ok", usable("v", "l"))
    reps = all_rows.filter("ok").groupBy(F.col("l").alias("label"), F.col("v").alias("vector")).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "vectors")
    lengths = sorted(r[0] for r in reps.select(F.size("vector").alias("length")).distinct().collect())  # those that occur
    if not lengths:
        return all_rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = reduce(DataFrame.unionByName, [_linked(reps.filter(F.size("vector") == n), least, recall, max_sample) for n in lengths])
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("root").alias("a"), F.col("node").alias("b")))
    tops = reps.join(roots, "node", "left").withColumn("top", F.coalesce("root", "node")).join(counts, "node", "left")
    ids = tops.groupBy(F.col("top").alias("t")).agg(F.min("least").alias("component"))
    classes = tops.join(ids, F.col("top") == F.col("t")).select("label", "vector", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("others"))
    classes = written(classes, "vector-classes")
    # copies meet their class by label and value; only rows that can have one take part
    joined = all_rows.filter("ok").join(classes, (F.col("l") == F.col("label")) & (F.col("v") == F.col("vector")))
    linked = joined.select("id", F.col("others").alias("n_links"), F.col("component").alias("component_id"))
    out = linked.unionByName(all_rows.filter("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
