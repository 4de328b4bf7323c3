"""Search for further context inside a comparison: a bounded loop over the mappings whose review asks for it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from filingdelta.operators.related import MAX_ROUNDS, TOP_K, related_topk
from filingdelta.operators.reviews import enhanced_summary, search_gate
from filingdelta.session import materialise

KEY = ["pair_id", "mapping_index"]
ROUND = "array<struct<iteration:int,search_keywords:array<string>,found_sections:array<struct<rank:int,section_name:string,similarity:double>>,new_findings:array<string>>>"


def search_rounds(
    reviews: DataFrame, rounds: DataFrame, vectors: DataFrame, mode: str, k: int = TOP_K, max_rounds: int = MAX_ROUNDS, dimension: int = 1536
) -> DataFrame:
    """``reviews`` with additional_searches, has_additional_context and the summary that tells what the searches found.

    ``reviews``: pair_id, mapping_index, doc1_id, doc1_section_name, importance, search_needed, search_phrases, summary.
    ``rounds``: (pair_id, mapping_index, iteration, phrases, vector, new_findings), a model's phrases for a round, their
    vector and what it made of the sections found; without phrases the search stops. ``vectors``: the sections with content.
    The frontier is a table per round: the mappings still searching, with the sections they have seen. A round searches for
    all of them at once and is computed once; a mapping that the gate keeps out is in no round.
    """
    open_gate = search_gate(F.col("search_needed"), F.col("importance"), F.col("search_phrases"), mode)
    frontier = reviews.where(open_gate).select(*KEY, F.col("doc1_id").alias("document_id"), F.array("doc1_section_name").alias("exclude"))
    query = F.concat_ws("/", F.col("pair_id").cast("string"), F.col("mapping_index").cast("string"))
    done = []
    for i in range(1, max_rounds + 1) if mode != "off" else ():
        told = rounds.where((F.col("iteration") == i) & (F.size("phrases") > 0)).select(*KEY, "phrases", "vector", "new_findings")
        asked = materialise(frontier.join(told, KEY).withColumn("query_id", query), "frontier")
        hits = related_topk(asked.select("query_id", "document_id", F.col("mapping_index").alias("ordinal"), "vector", "exclude"), vectors, k, dimension)
        found = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "section_name", "similarity"))).alias("found"))
        state = materialise(asked.drop("vector").join(found, "query_id"), "round")
        done.append(state.select(*KEY, F.struct(F.lit(i).alias("iteration"), F.col("phrases").alias("search_keywords"), F.col("found").alias("found_sections"), "new_findings").alias("_round")))
        frontier = state.select(*KEY, "document_id", F.array_union("exclude", F.transform("found", lambda f: f["section_name"])).alias("exclude"))
    nothing = F.array().cast(ROUND)
    if done:
        listed = reduce(DataFrame.unionByName, done).groupBy(*KEY).agg(F.sort_array(F.collect_list("_round")).alias("_rounds"))
        out = reviews.join(listed, KEY, "left").withColumn("additional_searches", F.coalesce(F.col("_rounds").cast(ROUND), nothing)).drop("_rounds")
    else:
        out = reviews.withColumn("additional_searches", nothing)
    return out.withColumn("has_additional_context", F.size("additional_searches") > 0).withColumn(
        "summary", enhanced_summary(F.col("summary"), F.transform("additional_searches", lambda s: s["new_findings"]))
    )
