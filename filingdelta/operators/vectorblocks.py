"""Vectors of a document as dense blocks of similar ones, with bounds that tell which blocks need not meet."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from filingdelta.functions.ordinals import number_within

BLOCK_VALUES, BLOCK_ROWS = 262_144, 1_024
# Directions by whose sides vectors are ordered, and the seed that draws them.
PLANES, SEED = 30, 7
# Cosines are compared with bounds up to this much rounding.
SLACK = 1e-9


def block_rows(dimension: int) -> int:
    """Rows per block: two megabytes of vectors at most, and a product of two blocks that fits a task."""
    return min(BLOCK_ROWS, max(8, BLOCK_VALUES // max(1, dimension)))


def matrix_of(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


@F.arrow_udf(T.LongType())
def _sides(vectors: pa.Array) -> pa.Array:
    """On which sides of fixed random planes a vector lies: vectors at a small angle mostly agree, first bits first."""
    matrix = matrix_of(vectors)
    planes = np.random.default_rng(SEED).standard_normal((matrix.shape[1], PLANES))
    return pa.array(((matrix @ planes > 0) @ (1 << np.arange(PLANES)[::-1])).astype(np.int64))


@F.arrow_udf(T.StructType([T.StructField("pivot", T.ArrayType(T.DoubleType())), T.StructField("radius", T.DoubleType()), T.StructField("has_zero", T.BooleanType())]))
def _cone(vectors: pa.Array) -> pa.Array:
    """The middle direction of each block, the greatest angle of a vector to it, and whether a vector has no direction."""
    sizes = np.diff(vectors.offsets.to_numpy())
    matrix, begins = matrix_of(vectors.flatten()), np.cumsum(sizes) - sizes
    norms = np.linalg.norm(matrix, axis=1)
    units = np.divide(matrix, norms[:, None], out=np.zeros_like(matrix), where=norms[:, None] > 0)
    middle = np.add.reduceat(units, begins) if len(begins) else matrix
    length = np.linalg.norm(middle, axis=1)
    pivot = np.divide(middle, length[:, None], out=middle.copy(), where=length[:, None] > 0)
    angle = np.where(norms > 0, np.arccos(np.clip((units * np.repeat(pivot, sizes, axis=0)).sum(axis=1), -1, 1)), 0)
    radius = np.where(length > 0, np.maximum.reduceat(angle, begins), np.pi) if len(begins) else length
    has_zero = np.logical_or.reduceat(norms == 0, begins) if len(begins) else length > 0
    rows = [{"pivot": p, "radius": r, "has_zero": z} for p, r, z in zip(pivot, radius.tolist(), has_zero.tolist())]
    return pa.array(rows, type=pa.struct([("pivot", pa.list_(pa.float64())), ("radius", pa.float64()), ("has_zero", pa.bool_())]))


@F.arrow_udf(T.DoubleType())
def _nearest_cosine(pivot1: pa.Array, radius1: pa.Array, pivot2: pa.Array, radius2: pa.Array) -> pa.Array:
    gap = np.arccos(np.clip((matrix_of(pivot1) * matrix_of(pivot2)).sum(axis=1), -1, 1))
    return pa.array(np.cos(np.maximum(gap - radius1.to_numpy() - radius2.to_numpy(), 0)))


def greatest_cosine(one: str, two: str) -> Column:
    """No vector of the one cone has a greater cosine with one of the other; a vector without direction has 0 with all."""
    a, b = F.col(one), F.col(two)
    bound = _nearest_cosine(a["pivot"], a["radius"], b["pivot"], b["radius"])
    return F.when(a["has_zero"] | b["has_zero"], F.greatest(bound, F.lit(0.0))).otherwise(bound) + SLACK


def vector_blocks(vectors: DataFrame, size: int, fields: list[str]) -> DataFrame:
    """``(document_id, block, items, cone)``: a document's rows in full blocks of ``size``, only the last one has fewer.

    Rows stand in the order of the sides they are on, so a block holds similar vectors and its cone is narrow. ``vectors`` has
    document_id, ordinal, vector and the other ``fields`` of an item.
    """
    rows = vectors.withColumn("vector", F.col("vector").cast("array<double>")).withColumn("_sides", _sides("vector"))
    placed = number_within(rows, ["document_id"], [F.col("_sides"), F.col("ordinal")], "_place")
    packed = placed.groupBy("document_id", F.floor((F.col("_place") - 1) / size).alias("block")).agg(
        F.collect_list(F.struct("ordinal", *fields, "vector")).alias("items")
    )
    return packed.withColumn("cone", _cone(F.col("items.vector")))


def unpack(items: pa.StructScalar | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by ordinal, ordinals, matrix and row norms of one block."""
    ordinals = items.field("ordinal").to_numpy(zero_copy_only=False)
    order = np.argsort(ordinals, kind="stable")
    matrix = matrix_of(items.field("vector"))[order]
    return order, ordinals[order], matrix, np.linalg.norm(matrix, axis=1)


def similarities(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """All cosines between two blocks; 0 where a vector has no length."""
    scale = np.outer(na, nb)
    return np.divide(a @ b.T, scale, out=np.zeros_like(scale), where=scale != 0)
