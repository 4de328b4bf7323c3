"""Input tables for the registered queries, derived from the given tables.

Most definitions are plain SQL that Spark and the checking engine both read, so
the two sides start from the same rows; only the operators differ. Table names
stand in braces; braces that belong to the SQL are doubled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filingdelta.operators.classify import Lexicon
from filingdelta.operators.sections import page_batches

PAGE_LINES = 3

# Classification words per language; the documents' languages stand in for filing types.
LANGUAGE_KEYWORDS = {
    "de": ["der", "die", "sch", "und", "icht", "ein", "keit"],
    "en": ["the", "and", "ing", "with", "that", "was"],
    "es": ["el", "los", "con", "ción", "para", "ñ"],
    "fr": ["le", "la", "que", "eaux", "tre", "é", "oi"],
    "none": [],
}
LANGUAGE_LABELS = {"de": "German", "en": "English", "fr": "French"}

SHARED = {
    # Conversation turns as uploaded files of one batch per conversation.
    "uploads": """
SELECT conv_id AS batch_id, turn,
  'turn-' || CAST(turn AS STRING) || '.pdf' AS filename,
  CASE role WHEN 'user' THEN CASE WHEN turn = 2 THEN '' ELSE 'application/pdf' END
            WHEN 'assistant' THEN 'application/PDF' ELSE 'text/plain' END AS content_type,
  CASE role WHEN 'user' THEN '%PDF-1.7 ' || text WHEN 'system' THEN '' ELSE text END AS body
FROM {conversations}""",
    # Document metadata: the language is the detected type, labels give manual overrides.
    "metadata": """
SELECT CAST(d.doc_id AS STRING) AS document_id, d.source || '_' || d.lang || '.pdf' AS filename,
  '/uploads/' || CAST(d.doc_id AS STRING) || '.pdf' AS stored_path, d.n_chars AS size_bytes,
  CASE d.lang WHEN 'en' THEN 'securities_report' WHEN 'fr' THEN 'earnings_report'
              WHEN 'de' THEN 'unknown' ELSE '' END AS detected_type,
  CASE d.lang WHEN 'en' THEN 'Securities' WHEN 'fr' THEN 'Earnings' ELSE '' END AS detected_type_label,
  CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'unknown'
       WHEN l.quality = 0 THEN 'integrated_report' ELSE '' END AS manual_type,
  CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 0 THEN 'Integrated' ELSE '' END AS manual_type_label,
  'accepted' AS status, 'queued' AS processing_status,
  '2024-01-' || lpad(CAST(1 + d.doc_id % 28 AS STRING), 2, '0') || 'T'
    || lpad(CAST(d.doc_id % 24 AS STRING), 2, '0') || ':' || lpad(CAST(d.doc_id % 60 AS STRING), 2, '0')
    || ':00' || CASE d.lang WHEN 'es' THEN '+00:00' WHEN 'de' THEN '' ELSE 'Z' END AS created_at
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "status_events": """
SELECT event_id, CAST(user_id AS STRING) AS document_id, CAST(ts AS TIMESTAMP) AS ts,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'extracting_text'
                  WHEN 'purchase' THEN 'structured' ELSE 'failed' END AS processing_status
FROM {events}""",
    # Documents with company, type and year: one per order.
    "filings": """
SELECT o_orderkey AS document_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN c_name || ' Inc.' WHEN '2' THEN c_name || ' Limited'
    WHEN '3' THEN c_name || ' (old)' WHEN '4' THEN upper(c_name) || ' Holdings' ELSE NULL END AS company_name,
  NULLIF(o_orderstatus, 'P') AS document_type,
  CASE WHEN o_totalprice < 100000 THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS fiscal_year
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "requests": """
SELECT CAST(floor(o_custkey / 2) * 10000 + year(o_orderdate) AS BIGINT) AS comparison_id,
  o_orderkey AS position, o_orderkey AS document_id
FROM {orders}""",
    # Table cells: one document per shipping month, one table per part type, one row per brand.
    "cells": """
SELECT document_id, table_id, "row", "col", item_name,
  CASE "col" WHEN 1 THEN digits || '千円' WHEN 2 THEN ' ' || digits || ' 百万円 ' WHEN 3 THEN digits || ' 円'
    WHEN 4 THEN digits || '株' WHEN 5 THEN '-' || digits || '%' WHEN 6 THEN '△' || digits || '.5十億円'
    ELSE CASE WHEN q > 150 THEN digits ELSE 'n/a' END END AS text
FROM (
  SELECT document_id, table_id, "row", "col", item_name, q,
    CASE WHEN q >= 1000 THEN CAST(CAST(floor(q / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST(q % 1000 AS STRING), 3, '0')
         ELSE CAST(q AS STRING) END AS digits
  FROM (
    SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS document_id, p_type AS table_id,
      CAST(substr(p_brand, 7) AS INT) AS "row", l_linenumber AS "col", p_brand AS item_name,
      CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q
    FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
    GROUP BY year(l_shipdate) * 100 + month(l_shipdate), p_type, p_brand, l_linenumber
  ) s
) t""",
    # Each month against the same month of the next year.
    "month_pairs": """
SELECT CAST(a.document_id AS STRING) AS pair_id, a.document_id AS doc1_id, a.document_id + 100 AS doc2_id
FROM (SELECT DISTINCT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS document_id FROM {lineitem}) a""",
    # KPI statements: one document per customer and year, one KPI per order.
    "kpis": """
SELECT CAST(o_custkey * 10000 + year(o_orderdate) AS BIGINT) AS document_id, 'orders' AS section_name,
  o_orderkey AS pos, o_orderpriority AS indicator,
  CASE WHEN o_totalprice < 50000 THEN '' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS point,
  NULLIF(o_orderstatus, 'P') AS trend_stated,
  CAST(CAST(floor(o_totalprice / 200000) AS BIGINT) AS STRING) AS target_description,
  CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE NULL END AS comment
FROM {orders}""",
    "customer_mappings": """
SELECT CAST(d.document_id AS STRING) AS pair_id, CAST(1 AS BIGINT) AS mapping_index,
  d.document_id AS doc1_id, d.document_id + 1 AS doc2_id, 'orders' AS doc1_section, 'orders' AS doc2_section
FROM (SELECT DISTINCT CAST(o_custkey * 10000 + year(o_orderdate) AS BIGINT) AS document_id FROM {orders}) d""",
    # Relations: one document per supplier and year, one relation per line item.
    "relations": """
SELECT CAST(l_suppkey * 10000 + year(l_shipdate) AS BIGINT) AS document_id, 'items' AS section_name,
  l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents,
  CASE l_linenumber WHEN 1 THEN 'causality' WHEN 2 THEN 'condition_consequence' WHEN 3 THEN 'problem_solution'
    WHEN 4 THEN 'premise_conclusion' WHEN 5 THEN 'other' ELSE NULL END AS relationship_type,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS a, l_linestatus AS b,
  'quantity ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' of part group '
    || CAST(CAST(floor(l_partkey / 50) AS BIGINT) AS STRING) AS original_text
FROM {lineitem}""",
    "supplier_mappings": """
SELECT CAST(d.document_id AS STRING) AS pair_id, CAST(1 AS BIGINT) AS mapping_index,
  d.document_id AS doc1_id, d.document_id + 1 AS doc2_id, 'items' AS doc1_section, 'items' AS doc2_section
FROM (SELECT DISTINCT CAST(l_suppkey * 10000 + year(l_shipdate) AS BIGINT) AS document_id FROM {lineitem}) d""",
    # Classification replies for labelled documents, some of them unusable.
    "type_replies": """
SELECT d.doc_id, d.source || '.pdf' AS filename, d.text AS text_sample,
  CASE WHEN l.quality IS NULL THEN NULL
       WHEN d.lang = 'es' THEN '{{"document_type": "es"'
       WHEN l.toxic = 1 AND l.quality = 0 THEN '[]'
       WHEN l.toxic = 1 THEN '{{"document_type": "unknown", "confidence": "high", "reason": 7}}'
       WHEN l.quality = 0 THEN '{{"document_type": "memo", "confidence": 0.9}}'
       WHEN d.lang = 'fr' THEN '{{"document_type": "fr", "confidence": 1.7, "reason": "style"}}'
       WHEN d.lang = 'de' THEN '{{"document_type": "de", "confidence": true}}'
       ELSE '{{"document_type": "en", "confidence": 0.' || CAST(d.n_chars % 100 AS STRING) || ', "reason": "words"}}'
  END AS reply_json
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    # Content replies: one section per order, with lists of varying length.
    "content_replies": """
SELECT o_orderkey AS document_id, 'order ' || CAST(o_orderkey AS STRING) AS section_name,
  CASE WHEN o_orderstatus = 'P' AND substr(o_orderpriority, 1, 1) = '5' THEN '{{bad'
       WHEN o_orderstatus = 'P' AND substr(o_orderpriority, 1, 1) = '4' THEN ''
       WHEN o_orderstatus = 'P' AND substr(o_orderpriority, 1, 1) = '3' THEN '{{}}'
  ELSE '{{"financial_data": [{{"item": "total", "value": ' || total || ', "unit": "円", "period": "' || yr || '"'
    || CASE WHEN o_orderstatus = 'F' THEN ', "context": "settled"' ELSE '' END || '}}'
    || CASE WHEN o_totalprice > 200000 THEN ', {{"item": "tax", "value": {{"low": 1}}, "unit": "%", "period": "' || yr || '"}}' ELSE '' END
    || '], "factual_info": [{{"category": "customer", "item": "key", "value": "' || cust || '"}}]'
    || CASE WHEN o_orderstatus = 'O' THEN ', "accounting_notes": [{{"topic": "open", "content": "not settled", "type": "注記"}}]' ELSE '' END
    || ', "messages": [{{"type": "方針", "content": "priority ' || o_orderpriority || '", "tone": "neutral"}}, {{"type": "リスク", "content": "late", "tone": "negative"}}]'
    || ', "kpi_time_series": [{{"indicator": "sales", "unit": "円", "time_series": [{{"period": "' || yr || '", "value": ' || total || '}}]'
    || ', "stated_metrics": {{"trend_stated": "' || o_orderstatus || '"}}, "target_stated": {{"target_description": "grow"}}}}]'
    || ', "logical_relationships": [{{"relationship_type": "causality", "original_text": "because ' || cust || '", "subject": "a", "reason": "b"}}]'
    || ', "segment_time_series": [{{"segment_name": "seg", "revenue_time_series": [{{"period": "' || yr || '", "value": ' || total || '}}]}}]}}'
  END AS reply_json
FROM (SELECT *, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS total, CAST(year(o_orderdate) AS STRING) AS yr,
        CAST(o_custkey AS STRING) AS cust FROM {orders}) o""",
    # Review replies: one comparison per customer, one review per order.
    "review_replies": """
SELECT CAST(o_custkey AS STRING) AS comparison_id, CAST(o_custkey AS STRING) AS pair_id, o_orderkey AS mapping_index,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'consistency_check' ELSE 'diff_analysis_year' END AS mode,
  CASE WHEN o_orderstatus = 'P' AND o_totalprice < 100000 THEN '{{broken'
       WHEN o_orderstatus = 'P' AND o_totalprice < 150000 THEN ''
       WHEN o_orderstatus = 'P' AND o_totalprice < 200000 THEN 'null'
  ELSE '{{"text_changes": {{"added": ["' || o_orderstatus || '"]'
    || CASE WHEN o_orderpriority = '2-HIGH' THEN ', "contradictions": ["x", "y"]' ELSE '' END || '}}'
    || CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 250000 THEN ', "contradictions": [{{"a": 1}}]' ELSE '' END
    || CASE WHEN o_orderstatus = 'O' THEN '' ELSE ', "importance": "' || CASE WHEN o_totalprice > 300000 THEN 'high' ELSE 'low' END || '"' END
    || CASE WHEN o_orderstatus = 'F' THEN ', "importance_reason": "amount"' ELSE '' END
    || ', "numerical_changes": [1, 2], "tone_analysis": {{"tone1": "calm"}}, "summary": "Order ' || CAST(o_orderkey AS STRING)
    || '", "additional_search": {{"needed": ' || CASE WHEN o_totalprice > 200000 THEN 'true' ELSE 'false' END
    || ', "search_phrases": [' || CASE WHEN o_orderstatus = 'F' THEN '' ELSE '"more"' END || ']}}}}' END AS reply_json
FROM {orders}""",
    # Report rows: one comparison per customer; the section is the order's priority.
    "reviews": """
SELECT CAST(o_custkey AS STRING) AS comparison_id, o_orderkey AS mapping_index,
  o_orderpriority AS section_name, NULLIF(o_orderpriority, '5-LOW') AS doc1_section_name,
  o_orderstatus || '-part' AS doc2_section_name,
  CASE WHEN o_orderstatus = 'P' THEN '?-?' ELSE CAST(1 + o_orderkey % 40 AS STRING) || '-' || CAST(45 + o_orderkey % 7 AS STRING) END AS doc1_page_range,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(1 + o_orderkey % 9 AS STRING) || '-60' END AS doc2_page_range,
  CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 150000 THEN 'medium' ELSE 'low' END AS importance,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'Total ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS summary,
  o_orderdate AS finished_at, o_totalprice
FROM {orders}""",
    "comparisons": """
SELECT CAST(c_custkey AS STRING) AS comparison_id,
  '2024-02-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || 'T00:00:00Z' AS created_at,
  CASE c_mktsegment WHEN 'BUILDING' THEN NULL ELSE 'diff_analysis_year' END AS mode, 'medium' AS priority,
  CAST(c_custkey AS STRING) || '-1' AS doc1_document_id, NULLIF(c_name || '.pdf', 'Customer#000000007.pdf') AS doc1_filename,
  c_name AS doc1_company, CAST(2000 + c_nationkey AS INT) AS doc1_year,
  CAST(c_custkey AS STRING) || '-2' AS doc2_document_id,
  CASE c_mktsegment WHEN 'MACHINERY' THEN NULL ELSE c_mktsegment || '.pdf' END AS doc2_filename,
  CASE c_mktsegment WHEN 'FURNITURE' THEN NULL ELSE c_mktsegment END AS doc2_company, CAST(NULL AS INT) AS doc2_year
FROM {customer}""",
    # Near copies: every document with the first document that opens with the same line,
    # and every turn of a conversation with the next but one, which is its speaker's next.
    "copy_pairs": """
SELECT 'd' || CAST(d.doc_id AS STRING) AS pair_id, f.first_id AS doc1_id, d.doc_id AS doc2_id
FROM (SELECT doc_id, {first_line} AS line FROM {documents}) d
JOIN (SELECT {first_line} AS line, min(doc_id) AS first_id FROM {documents} GROUP BY {first_line}) f ON d.line = f.line
WHERE d.doc_id <> f.first_id""",
    "turn_pairs": """
SELECT 'c' || CAST(a.conv_id AS STRING) || '-' || CAST(a.turn AS STRING) AS pair_id, a.text AS text1, b.text AS text2
FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2""",
    # Customers and suppliers under various legal forms, and the customers' national branches.
    "company_names": """
SELECT 'c' || CAST(c_custkey AS STRING) AS name_id, c_name || CASE c_mktsegment WHEN 'BUILDING' THEN ' Inc.' WHEN 'MACHINERY' THEN ' Limited'
  WHEN 'FURNITURE' THEN ' (old)' ELSE '' END AS name FROM {customer}
UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), upper(s_name) || ' Holdings' FROM {supplier}
UNION ALL SELECT 'b' || CAST(c_custkey AS STRING), c_name || ' ' || n_name || ' Ltd.' FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    # A catalogue type per benchmark item; its sentences are the keywords. JSON is YAML as well.
    "catalogue_words": """
SELECT item_id, CASE WHEN item_id % 5 = 0 THEN NULL ELSE 'Item ' || CAST(item_id AS STRING) END AS label, text FROM {benchmark}""",
    # The region, nation and customer hierarchy as template nodes.
    "nodes": """
SELECT 'market' AS document_type, 'r' || CAST(r_regionkey AS STRING) AS node_id, CAST(NULL AS STRING) AS parent_id,
  r_regionkey AS ordinal, r_name AS name, TRUE AS required FROM {region}
UNION ALL
SELECT 'market', 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING), n_nationkey,
  NULLIF(n_name, 'NATION_3'), FALSE FROM {nation}
UNION ALL
SELECT 'market', 'c' || CAST(c_custkey AS STRING), 'n' || CAST(c_nationkey AS STRING), CAST(c_custkey AS INT),
  c_name, FALSE FROM {customer}""",
}


class Tables:
    """The given tables below one folder, and the tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """A small file arrives as one split: share its rows out before costly work. Big tables keep their splits."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df

    def shared(self, name: str, **inputs: DataFrame) -> DataFrame:
        """A SHARED definition; given tables it names are read, others must be passed in."""
        sql = SHARED[name].replace('"row"', "`row`").replace('"col"', "`col`")
        sql = sql.replace("{first_line}", "split_part(text, chr(10), 1)")
        for table in GIVEN:
            if "{" + table + "}" in sql:
                inputs.setdefault(table, self.base(table))
        if name in SPREAD:
            inputs["orders"] = self.spread(inputs["orders"])
        return self.spark.sql(sql, **inputs)

    def languages(self) -> Lexicon:
        return Lexicon.of(self.spark, LANGUAGE_KEYWORDS, LANGUAGE_LABELS)

    def pages(self) -> DataFrame:
        """Pages of three lines, cut inside each row without a shuffle."""
        lines = F.split("text", "\n")
        n_pages = F.ceil(F.size("_lines") / PAGE_LINES)
        cut = F.transform(
            F.sequence(F.lit(0), (n_pages - 1).cast("int")),
            lambda i: F.array_join(F.slice("_lines", i * PAGE_LINES + 1, PAGE_LINES), "\n"),
        )
        return (
            self.spread(self.base("documents").select("doc_id", "text"))
            .select(F.col("doc_id").alias("document_id"), lines.alias("_lines"))
            .select("document_id", F.posexplode(cut).alias("_i", "text"))
            .select("document_id", (F.col("_i") + 1).cast("int").alias("page_number"), "text")
        )

    def candidates(self) -> DataFrame:
        """Section candidates per page window: three levels, and parents detected on their own.

        One row per window and two-page stretch; the stretch that opens a window
        also names the top section, the one that closes it an appendix.
        """
        def label(letter: str, page: Column, size: int) -> Column:
            return F.concat(F.lit(letter), F.floor((page - 1) / size).cast("string"))

        def candidate(ordinal: Column, name: Column, start: Column, end: Column, confidence: Column, goes_on: Column) -> Column:
            return F.struct(
                ordinal.cast("int").alias("ordinal"), name.alias("section_name"), start.alias("start_page"),
                end.cast("int").alias("end_page"), confidence.cast("double").alias("confidence"),
                goes_on.alias("is_continuing"),
            )

        windows = page_batches(self.pages().select("document_id", "page_number"))
        stretch = windows.groupBy(
            "document_id", "batch_index", "batch_start", "batch_end", F.floor((F.col("page_number") - 1) / 2).alias("_u")
        ).agg(F.min("page_number").alias("_from"), F.max("page_number").alias("_to"))
        first, last, opens, closes = F.col("_from"), F.col("_to"), F.col("batch_start"), F.col("batch_end")
        name = F.concat_ws(" - ", label("S", first, 8), label("T", first, 4), label("U", first, 2))
        share = (10 - (F.col("document_id") + F.col("batch_index")) % 5).cast("double") / 10
        found = F.array_compact(
            F.array(
                candidate(F.col("_u"), name, first, last, share, last == closes),
                F.when(first == opens, candidate(F.lit(-1), label("S", opens, 8), opens, opens + 2, F.lit(0.5), F.lit(False))),
                F.when(last == closes, candidate(F.lit(-2), F.lit("Appendix"), closes, closes, F.lit(None), F.lit(True))),
            )
        )
        return stretch.select("document_id", "batch_index", F.explode(found).alias("c")).select(
            "document_id", "batch_index", "c.*"
        )

    def vectors(self) -> DataFrame:
        """Embeddings as section vectors; the label is the document."""
        return self.base("embeddings").select(
            F.col("label").cast("long").alias("document_id"), F.col("vec_id").alias("ordinal"),
            F.concat(F.lit("sec-"), F.col("vec_id").cast("string")).alias("section_name"),
            F.col("embedding").cast("array<double>").alias("vector"),
        )

    def text_pairs(self, max_chars: int | None = None) -> DataFrame:
        """Pairs of whole texts, or of their leading characters for the operator that compares those."""
        text = F.col("text") if max_chars is None else F.substring("text", 1, max_chars)
        texts = self.base("documents").select("doc_id", text.alias("text"))
        pairs = self.shared("copy_pairs")
        one = texts.select(F.col("doc_id").alias("doc1_id"), F.col("text").alias("text1"))
        two = texts.select(F.col("doc_id").alias("doc2_id"), F.col("text").alias("text2"))
        copies = pairs.join(one, "doc1_id").join(two, "doc2_id").select("pair_id", "text1", "text2")
        return copies.unionByName(self.shared("turn_pairs"))


# Definitions that build long JSON texts, which are then parsed.
SPREAD = ("content_replies", "review_replies")

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
