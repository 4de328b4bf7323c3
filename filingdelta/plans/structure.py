"""Structuring of documents: candidates and pages to sections ready for extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame

from filingdelta.operators.sections import (
    exclusive_pages, extraction_eligible, merge_sections, rebuild_parents, section_text, with_char_count,
)


def detect(candidates: DataFrame, pages: DataFrame, own_pages_only: bool = False) -> DataFrame:
    """Merged sections with their character counts and rebuilt parents.

    ``own_pages_only`` leaves out pages that the document does not have; without it they are listed as the replies told them.
    """
    merged = merge_sections(candidates, pages if own_pages_only else None)
    return rebuild_parents(with_char_count(merged, pages), pages)


def extraction_inputs(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Text of each section worth extracting, over the pages it has to itself."""
    return extraction_eligible(section_text(exclusive_pages(sections), pages))
