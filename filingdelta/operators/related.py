"""Finding related sections by vector, in one or two rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from filingdelta.operators.vectorblocks import block_rows, greatest_cosine, similarities, unpack, vector_blocks
from filingdelta.session import materialise

TOP_K, MAX_ROUNDS = 3, 2
_HIT = "asked string, query_id string, ordinal long, section_name string, similarity double"
_HIT_SCHEMA = pa.schema(
    [("asked", pa.string()), ("query_id", pa.string()), ("ordinal", pa.int64()), ("section_name", pa.string()), ("similarity", pa.float64())]
)


def _top_in_block(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, blocks, queries = batch.column("asked"), batch.column("items"), batch.column("queries")
            for i in range(batch.num_rows):
                by, ordinals, matrix, norms = unpack(blocks[i].values)
                names = blocks[i].values.field("section_name").take(pa.array(by))
                asked, _, wanted, lengths = unpack(queries[i].values)
                sim = similarities(wanted, lengths, matrix, norms)
                place = {n: j for j, n in enumerate(names.to_pylist())}
                for j, excluded in enumerate(queries[i].values.field("exclude").take(pa.array(asked)).to_pylist()):
                    sim[j, [place[n] for n in excluded or () if n in place]] = -np.inf
                # Of equal cosines the first ordinal comes first.
                best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                rows, columns = np.repeat(np.arange(len(best)), best.shape[1]), best.ravel()
                free = sim[rows, columns] > -np.inf
                rows, columns = rows[free], columns[free]
                ids = queries[i].values.field("query_id").take(pa.array(asked[rows]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[i].as_py()] * len(rows), pa.string()), ids, pa.array(ordinals[columns], pa.int64()),
                        names.take(pa.array(columns)), pa.array(sim[rows, columns], pa.float64()),
                    ],
                    schema=_HIT_SCHEMA,
                )

    return run


def related_topk(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, dimension: int = 1536) -> DataFrame:
    """The k sections of the document nearest to each query vector, ties in section order.

    ``queries``: (query_id, document_id, ordinal, vector, exclude array<string>), one row per query_id;
    ``vectors``: sections with content only. Queries and sections meet as blocks of similar vectors; each block pair returns at
    most k rows per query. A block of queries first meets the block that its cone lies nearest to; the worst k-th cosine found
    there is a bar that other blocks' cones must reach to be shipped, so the result is exact.
    """
    size = block_rows(dimension)
    ready = queries.withColumn("query_id", F.col("query_id").cast("string"))
    key = F.concat_ws("/", F.col("document_id").cast("string"), F.col("block").cast("string"))
    asked = vector_blocks(ready, size, ["query_id", "exclude"]).select("document_id", key.alias("asked"), F.col("items").alias("queries"), F.col("cone").alias("cone1"))
    asked, blocks = materialise(asked, "queries"), materialise(vector_blocks(vectors, size, ["section_name"]), "blocks")
    paired = asked.select("document_id", "asked", "cone1").join(blocks.select("document_id", "block", F.col("cone").alias("cone2")), "document_id")
    paired = materialise(paired.select("document_id", "asked", "block", greatest_cosine("cone1", "cone2").alias("bound")), "pairs")
    first = paired.groupBy("document_id", "asked").agg(F.max_by("block", F.struct("bound", -F.col("block"))).alias("block"))

    def searched(met: DataFrame) -> DataFrame:
        rows = met.join(asked.select("asked", "queries"), "asked").join(blocks.select("document_id", "block", "items"), ["document_id", "block"])
        return rows.select("asked", "queries", "items").mapInArrow(_top_in_block(k), _HIT)

    near = materialise(searched(first), "near")
    reached = near.groupBy("asked", "query_id").agg(F.count("*").alias("_n"), F.min("similarity").alias("_kth")).where(F.col("_n") >= k)
    bars = reached.groupBy("asked").agg(F.count("*").alias("_full"), F.min("_kth").alias("_bar"))
    # A query that found fewer than k has no bar yet.
    bars = bars.join(asked.select("asked", F.size("queries").alias("_all")), "asked").select("asked", F.when(F.col("_full") == F.col("_all"), F.col("_bar")).alias("bar"))
    others = paired.join(first, ["document_id", "asked", "block"], "left_anti").join(bars, "asked", "left")
    hits = near.unionByName(searched(others.where(F.coalesce(F.col("bound") >= F.col("bar"), F.lit(True))).select("document_id", "asked", "block")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "ordinal"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).drop("asked")


def iterative_search(
    queries: DataFrame, vectors: DataFrame, k: int = TOP_K, rounds: int = MAX_ROUNDS, dimension: int = 1536
) -> DataFrame:
    """Search in rounds; what a round finds is excluded from the next. Each round's hits are computed once.

    ``queries`` also carries ``iteration``; a query without a row for a round,
    or without hits in the round before, stops there.
    """
    found, out = None, None
    for i in range(1, rounds + 1):
        asked = queries.where(F.col("iteration") == i)
        if found is not None:
            asked = asked.join(found, "query_id").withColumn(
                "exclude", F.array_union(F.coalesce("exclude", F.array().cast("array<string>")), "_found")
            ).drop("_found")
        hits = materialise(related_topk(asked, vectors, k, dimension).withColumn("iteration", F.lit(i)), "hits")
        out = hits if out is None else out.unionByName(hits)
        found = out.groupBy("query_id").agg(
            F.collect_set("section_name").alias("_found"), F.max("iteration").alias("_last")
        ).where(F.col("_last") == i).drop("_last")
    return out
