"""Whitening of embeddings with distributed block matrices.

The distinct integer vectors (the fit list) are numbered without gaps, centred exactly, and cut into the blocks of a
``BlockMatrix``; its transpose times itself is the scatter, summed over slabs and over splits of the inner dimension, so
that no task holds more than a few blocks. The eigenvectors come from one local decomposition (width x width). All rows
are numbered and blocked the same way and multiplied by the whitening matrix; the products meet their rows again by
block number, so a vector that is a third of the table moves like any other rows.

Numbers follow the order of a written table, so they stay when an executor is lost.

Defined results: rows whose vector is null or holds a null or a number that is not finite are left out; vectors of
each width are whitened apart, as a space of their own (an empty vector has no components and gives no rows); a
component whose variance is nothing but rounding has no whitened value (null), explains 0 and is left out of the
identity error; a deviation that does not fit a long is null; entries beyond 2^50 in size count as that; a row with a
null id is treated like any other; repeated rows give their rows each; an empty table gives none; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessella.llm.centroids import integer_vectors
from tessella.llm.common import discard, materialise

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
LIMIT = 1 << 50
#: Bytes of a block of doubles, blocks of a slab (BlockMatrix lists a slab's blocks on the driver), and blocks that a task multiplies.
BLOCK_BYTES, SLAB, TOGETHER = 1 << 19, 1 << 14, 8
_PLAIN = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType.elementType) if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in MatrixUDT.sqlType()])
_BLOCK_SCHEMA = T.StructType([T.StructField("at", T.StructType([T.StructField("_1", T.LongType()), T.StructField("_2", T.LongType())])), T.StructField("matrix", MatrixUDT())])


def _placed(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """The rows with a gapless ``__row`` from 0 (places in each part, plus the parts before it), and the written table they are in."""
    place = F.monotonically_increasing_id()
    table = materialise(df.withColumn("__part", F.shiftright(place, 33).cast("int")).withColumn("__place", place.bitwiseAND(F.lit((1 << 33) - 1))), label)
    sizes = table.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    # one row a part of the written table
    return table.join(F.broadcast(before), "__part").withColumn("__row", F.col("__place") + F.col("__before")).drop("__part", "__place", "__before"), table


def _centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x less the mean: the whole part of the mean is taken off exactly, so only the last division rounds."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.float64)
    return (x - whole) - rest / n


def deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """The sum over dimensions of (n x - sum)^2, exactly; None where it does not fit a long."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    off = x - whole
    size = float(np.abs(off).max(initial=0) + 1) * n
    if size * size * max(1, x.shape[1]) < 2**62:
        return ((off * n - rest) ** 2).sum(axis=1).tolist()
    exact = [sum((int(o) * n - int(r)) ** 2 for o, r in zip(row, rest)) for row in off.tolist()]
    return [d if d < 2**63 else None for d in exact]


def _blocks(rows: DataFrame, per_block: int, sums: list[int], n: int, ids: bool) -> DataFrame:
    """A written table of blocks: (slab, at, matrix), and ids and deviations where asked for."""
    width = len(sums)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__row")
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, width)
        block = table.column("__row")[0].as_py() // per_block
        values = _centred(x, sums, n).ravel(order="F")
        matrix = pa.array([{"type": 1, "numRows": len(x), "numCols": width, "colPtrs": None, "rowIndices": None, "values": values, "isTransposed": False}], _MATRIX_ARROW)
        out = {"slab": pa.array([block // SLAB], pa.int32()), "at": pa.array([{"_1": block % SLAB, "_2": 0}]), "matrix": matrix}
        if ids:
            out |= {"ids": pa.array([table.column("vec_id").to_pylist()], pa.list_(pa.int64())), "deviations": pa.array([deviations(x, sums, n)], pa.list_(pa.int64()))}
        return pa.table(out)

    schema = T.StructType([T.StructField("slab", T.IntegerType()), _BLOCK_SCHEMA["at"], T.StructField("matrix", _PLAIN), *([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("deviations", T.ArrayType(T.LongType()))] if ids else [])])
    made = materialise(rows.withColumn("__block", F.floor(F.col("__row") / per_block)).groupBy("__block").applyInArrow(run, schema), "blocks")
    # the same files, with the matrices as MLlib's type
    typed = T.StructType([T.StructField("matrix", MatrixUDT()) if f.name == "matrix" else f for f in schema])
    return rows.sparkSession.read.schema(typed).parquet(*{f.rpartition("/")[0] for f in made.inputFiles()})


_MATRIX_ARROW = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())), ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])


def _matrix(blocks: DataFrame, per_block: int, wide: int, n_rows: int, n_columns: int) -> BlockMatrix:
    """A block matrix of a DataFrame's (at, matrix), handed over inside the JVM."""
    return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, per_block, wide, n_rows, n_columns), per_block, wide, n_rows, n_columns)


def _slabs(blocks: DataFrame, n: int, per_block: int, width: int) -> Iterator[tuple[int, BlockMatrix]]:
    total = -(-n // per_block)
    for slab in range(-(-total // SLAB)):
        rows = min(n - slab * SLAB * per_block, SLAB * per_block)
        yield slab, _matrix(blocks.where(F.col("slab") == slab).select("at", "matrix"), per_block, width, rows, width)


def _times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product, with the inner dimension dealt to ``splits`` tasks."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def scatter(matrices: Iterator[tuple[int, BlockMatrix]]) -> np.ndarray:
    """The sum over slabs of the transpose times the matrix."""
    parts = []
    for _, m in matrices:
        splits = max(1, -(-m.numRows() // (m.rowsPerBlock * TOGETHER)))
        parts.append(_times(m.transpose(), m, splits).toLocalMatrix().toArray())
    return reduce(np.add, parts)


def whitening_matrix(covariance: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns that whiten (zero where there is no variance), the eigenvalues, and the share that each explains."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    real = values > max(trace, 0.0) * len(covariance) * np.finfo(float).eps * 16
    return np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0), np.where(real, values, 0.0), np.where(real, values, 0.0) / trace if trace > 0 else np.zeros(len(values))


def _projected(spark: SparkSession, m: BlockMatrix, by: np.ndarray) -> BlockMatrix:
    right = spark.createDataFrame([((0, 0), DenseMatrix(*by.shape, by.ravel(order="F")))], _BLOCK_SCHEMA)
    return m.multiply(_matrix(right, *by.shape, *by.shape))


def _whiten_width(table: DataFrame, width: int, components: int, block_bytes: int) -> DataFrame:
    spark = table.sparkSession
    fit, written = _placed(table.where(F.size("x") == width).select("x").distinct(), "fit")
    counted = written.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()  # a row a dimension
    n, sums = counted[0]["n"], [int(r["s"]) for r in sorted(counted, key=lambda r: r["i"])]
    per_block = max(1, block_bytes // (8 * width))
    fit_blocks = _blocks(fit, per_block, sums, n, False)
    covariance = scatter(_slabs(fit_blocks, n, per_block, width)) / n
    by, values, shares = whitening_matrix(covariance, components)
    white = scatter((s, _projected(spark, m, by)) for s, m in _slabs(fit_blocks, n, per_block, width)) / n
    real = values > 0
    error = float(np.abs(white - np.eye(len(values)))[np.ix_(real, real)].max(initial=0.0))
    discard(written)
    discard(fit_blocks)

    rows, kept = _placed(table.where(F.size("x") == width), "rows")
    blocks = _blocks(rows, per_block, sums, n, True)
    discard(kept)
    total = blocks.select(F.sum(F.size("ids")).alias("n")).first()["n"]
    parts = []
    for slab, m in _slabs(blocks, total, per_block, width):
        product = callMLlibFunc("getMatrixBlocks", _projected(spark, m, by)._java_matrix_wrapper._java_model)
        parts.append(product.toDF("at", "white").select(F.lit(slab).alias("slab"), F.col("at._1").cast("long").alias("block"), "white"))
    met = blocks.select("slab", F.col("at._1").alias("block"), "ids", "deviations").join(reduce(DataFrame.union, parts), ["slab", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for b in batches:
            for r in range(b.num_rows):
                ids, found = b.column("ids")[r].values, b.column("deviations")[r].values
                white = np.array(b.column("white")[r]["values"].values.to_numpy()).reshape(k, len(ids)).T  # stored column by column
                again = np.repeat(np.arange(len(ids)), k)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))), pa.array(np.full(len(again), n)), found.take(pa.array(again)),
                    pa.array(white.ravel(), mask=np.tile(~real, len(ids))), pa.array(np.tile(shares, len(ids))), pa.array(np.full(len(again), error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return met.select("ids", "deviations", "white").mapInArrow(run, REPORT)


REPORT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitening_report(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row that takes part and component."""
    x = integer_vectors(rows, None, scale, LIMIT)
    table = materialise(x.withColumn("x", F.transform("x", lambda v: v + F.lit(shift))), "integers")
    widths = sorted(r["w"] for r in table.select(F.size("x").alias("w")).where("w > 0").distinct().collect())  # one as a rule
    if not widths:
        return rows.sparkSession.createDataFrame([], REPORT)
    made = [_whiten_width(table, w, components, block_bytes) for w in widths]
    discard(table)
    return reduce(DataFrame.union, made)
