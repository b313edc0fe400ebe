"""Embedding whitening with MLlib's BlockMatrix.

Vectors become integers, x = floor(256 c). The fit list is each distinct x once. Its rows,
numbered and centred, are an IndexedRowMatrix cut into blocks of ``BLOCK_ROWS`` rows; the
transposed matrix times the matrix is the scatter, its eigenvectors (numpy, on a matrix of
dimension by dimension) the components, and the BlockMatrix of all centred rows times the
whitening matrix projects every row. All of it is MLlib's own, rows go from Spark SQL to
the blocks and back without a Python worker on the way in.

The scatter of a tall matrix is one small block to which all blocks of rows contribute.
Multiplied as it is, they would all be sent to the task of that block, so the product's
middle dimension is cut into parts of ``SPLIT_BLOCKS`` blocks: a task holds that many, and
the parts, small squares, are added up.

Exact where integers allow it: sums by dimension, deviations and the mean's numerator are
longs (a deviation beyond a long's range is null). The covariance is that of the rows less
S / n in double precision, centred before multiplying.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries have
no result; rows that repeat an id or a vector each have theirs; vectors of another length
are a space of their own, with a fit of their own; entries whose 256-fold leaves the range
of a long stay at its end; components of no variance (an eigenvalue below 10^-12 of the
trace, as with one distinct vector) have null whitened values and are left out of the
identity error, and explained is null where the trace is 0; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

from stratus.llm.common import written

SCALE, COMPONENTS = 256, 4
#: Rows and most columns of a block; blocks of the middle dimension in a part of a product.
BLOCK_ROWS, BLOCK_COLS, SPLIT_BLOCKS = 1024, 1024, 16
#: Share of the trace below which an eigenvalue is none.
LEAST = 1e-12


def integers(vector: Column) -> Column:
    """floor(256 c) of each entry as long; null for vectors without a result."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    top, bottom = F.lit(2.0**63), F.lit(-(2.0**63))

    def whole(c: Column) -> Column:
        y = F.lit(float(SCALE)) * c.cast("double")
        inside = F.when((y < top) & (y >= bottom), y)
        return F.coalesce(F.floor(inside).cast("long"), F.when(y > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63))))

    return F.when(vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)), F.transform(vector, whole))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` written, with ``index``: 0, 1, ... in the order of the files' parts."""
    low = (1 << 33) - 1
    held = written(rows.withColumn("place", F.monotonically_increasing_id()), "whitening-rows")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit(low))
    sizes = held.groupBy(part.alias("part")).agg((F.max(within) + 1).alias("n")).collect()  # a row per task that wrote
    first, at = {}, 0
    for r in sorted(sizes):
        first[r["part"]] = at
        at += r["n"]
    starts = rows.sparkSession.createDataFrame(list(first.items()), "part long, first long")
    return held.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("index", F.col("first") + within).drop("part", "first", "place")


def _array(values, kind: str) -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def block_matrix(rows: DataFrame, mean: list[float], n_rows: int) -> BlockMatrix:
    """(index, x) centred, as blocks. Numbers that no row has are rows of zeros."""
    centred = F.zip_with(F.col("x"), _array(mean, "double"), lambda v, m: v.cast("double") - m)
    vectors = rows.select("index", array_to_vector(centred).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n_rows, len(mean))
    return matrix.toBlockMatrix(BLOCK_ROWS, BLOCK_COLS)


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """Transposed times itself, the rows' blocks in parts of SPLIT_BLOCKS."""
    splits = -(-blocks.numRowBlocks // SPLIT_BLOCKS)
    # PySpark's multiply has no parameter for the parts; the Scala method of that name has
    left, right = blocks.transpose()._java_matrix_wrapper, blocks._java_matrix_wrapper
    product = left._java_model.multiply(right._java_model, splits)
    return BlockMatrix(product, BLOCK_COLS, BLOCK_COLS).toLocalMatrix().toArray()  # dimension by dimension


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, and unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    return values[::-1], vectors[:, ::-1]


def _whitened(x: DataFrame, size: int, n_components: int) -> DataFrame:
    """Rows of one length: id, component, n, deviation, whitened, explained, identity_error."""
    spark = x.sparkSession
    rows = numbered(x)
    n_rows = rows.count()
    fit = written(rows.groupBy("x").agg(F.min("index").alias("index")), "whitening-fit")
    sums = fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()  # a row per dimension
    s = [int(r["s"]) for r in sorted(sums)]
    n = fit.count()
    mean = [v / n for v in s]

    covariance = scatter(block_matrix(fit, mean, n_rows)) / n
    values, vectors = components(covariance)
    k, trace = min(n_components, size), float(np.trace(covariance))
    used = [i for i in range(k) if values[i] > LEAST * trace]
    matrix = np.zeros((size, k))
    for i in used:
        matrix[:, i] = vectors[:, i] / np.sqrt(values[i])

    columns = [spark.sparkContext.parallelize([((b, 0), DenseMatrix(len(part), k, part.ravel(order="F")))], 1) for b, part in enumerate(np.array_split(matrix, range(BLOCK_COLS, size, BLOCK_COLS)))]
    whitening = BlockMatrix(spark.sparkContext.union(columns), BLOCK_COLS, BLOCK_COLS, size, k)
    projected = block_matrix(rows, mean, n_rows).multiply(whitening).toIndexedRowMatrix().rows
    y = written(spark.createDataFrame(projected.map(lambda r: (r.index, [float(v) for v in r.vector.toArray()])), "index long, y array<double>"), "whitening-projected")

    of_fit = y.join(fit.select("index"), "index")
    means = [F.avg(F.get("y", F.lit(i))).alias(f"m{i}") for i in used]
    products = [F.avg(F.get("y", F.lit(i)) * F.get("y", F.lit(j))).alias(f"p{i}_{j}") for i in used for j in used if j <= i]
    error = None
    if used:
        got = of_fit.agg(*means, *products).first()
        error = max(abs(got[f"p{i}_{j}"] - got[f"m{i}"] * got[f"m{j}"] - (i == j)) for i in used for j in used if j <= i)

    # n x - S fits a long where the sums of the fit list do; what doesn't is null
    big = lambda c: c.cast("decimal(38,0)")
    off = F.zip_with("x", _array(s, "decimal(38,0)"), lambda v, t: F.try_subtract(F.try_multiply(big(v), F.lit(n).cast("decimal(19,0)")).cast("decimal(38,0)"), t))
    square = F.aggregate(off, F.lit(0).cast("decimal(38,0)"), lambda a, v: F.try_add(a, F.try_multiply(v, v)).cast("decimal(38,0)"))
    explained = [float(max(values[i], 0.0)) / trace if trace > 0 else None for i in range(k)]
    each = F.array(*[F.struct(F.lit(i + 1).alias("component"), (F.get("y", F.lit(i)) if i in used else F.lit(None).cast("double")).alias("whitened"), F.lit(explained[i]).cast("double").alias("explained")) for i in range(k)])
    out = rows.select("index", "vec_id", square.try_cast("long").alias("deviation")).join(y, "index").withColumn("c", F.explode(each))
    return out.select("vec_id", F.col("c.component").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", n_components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each
    vector and each of its first ``n_components`` components."""
    x = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), integers(F.col(f"`{vector_col}`")).alias("x")).filter("x IS NOT NULL")
    sizes = [r[0] for r in x.select(F.size("x").alias("size")).distinct().collect()]  # the lengths that occur
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = vectors.sparkSession.createDataFrame([], schema.format(x.schema["vec_id"].dataType.simpleString()))
    for size in sorted(sizes):
        out = out.unionByName(_whitened(x.filter(F.size("x") == size), size, n_components))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
