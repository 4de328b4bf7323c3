"""Template catalogue: YAML files to type, keyword and node tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from filingdelta.operators.classify import Lexicon

try:
    import yaml
except ImportError:  # the catalogue source is the only user
    yaml = None

_ROWS = (
    "document_type string, kind string, ordinal int, node_id string, parent_id string, "
    "name string, required boolean, description string"
)


def _node_rows(kind: str, parent: str | None, children: Any) -> Iterator[tuple]:
    for i, child in enumerate(children):
        if not isinstance(child, dict) or not child.get("name"):
            continue
        node = f"{parent}.{i:04d}" if parent else f"{i:04d}"
        yield (kind, "node", i, node, parent, str(child["name"]), bool(child.get("required")), child.get("description"))
        below = [*(child.get("subsections") or ()), *(child.get("items") or ())]
        yield from _node_rows(kind, node, below)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    if yaml is None:
        raise ImportError("reading template files needs PyYAML")
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    columns = [c.split()[0] for c in _ROWS.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for kind, body in zip(batch["document_type"], batch["body"]):
            template = yaml.load(body, Loader=loader) or {}
            label = template.get("display_name", kind)
            rows.append((kind, "type", None, None, None, label, None, template.get("description", "")))
            for i, word in enumerate(template.get("keywords_for_detection") or ()):
                if isinstance(word, str):
                    rows.append((kind, "keyword", i, None, None, word.lower(), None, None))
            rows.extend(_node_rows(kind, None, template.get("sections") or ()))
        out = pd.DataFrame(rows, columns=columns)
        out["ordinal"] = out["ordinal"].astype("Int32")
        out["required"] = out["required"].astype("boolean")
        yield out


def parse_templates(bodies: DataFrame) -> DataFrame:
    """Rows of every template: its type, its detection keywords and its section nodes.

    ``bodies``: (document_type, body). A node's children are its subsections, then
    its items; entries that are no mapping, or have no name, are skipped.
    """
    return bodies.select("document_type", "body").mapInPandas(_parse, _ROWS)


def types_of(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'type'").select("document_type", F.col("name").alias("display_name"), "description")


def keywords_of(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'keyword'").select("document_type", "ordinal", F.col("name").alias("keyword"))


def nodes_of(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'node'").select(
        "document_type", "node_id", "parent_id", "ordinal", "name", "required"
    )


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*.yaml`` of a folder; the document type is the file's stem."""
    files = spark.read.option("pathGlobFilter", "*.yaml").text(folder, wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.yaml$", 1)
    return parse_templates(files.select(stem.alias("document_type"), F.col("value").alias("body")))


def template(rows: DataFrame, document_type: str) -> DataFrame:
    """Rows of one type; raises when the catalogue has none."""
    found = rows.where(F.col("document_type") == document_type)
    if found.isEmpty():
        raise FileNotFoundError(f"no template for document type {document_type!r}")
    return found


def load_lexicon(rows: DataFrame) -> Lexicon:
    """The catalogue's detection keywords and display names as tables of any size; nothing is fetched."""
    return Lexicon(
        keywords_of(rows).withColumnRenamed("document_type", "kind"),
        types_of(rows).select(F.col("document_type").alias("kind"), F.col("display_name").alias("label")),
    )
