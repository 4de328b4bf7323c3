"""Row shapes shared by the operators."""

from __future__ import annotations

METADATA = """
document_id string, filename string, stored_path string, size_bytes long,
detected_type string, detected_type_label string, detection_confidence double,
matched_keywords array<string>, detection_reason string,
manual_type string, manual_type_label string, status string, processing_status string,
created_at string, updated_at string, structured_data string,
extraction_method string, extraction_metadata map<string,string>
"""

# Extracted facts of a section: seven lists, values kept as text because they
# may be numbers or objects.
CONTENT = """
financial_data array<struct<item:string,value:string,unit:string,period:string,context:string>>,
accounting_notes array<struct<topic:string,content:string,type:string>>,
factual_info array<struct<category:string,item:string,value:string>>,
messages array<struct<type:string,content:string,tone:string>>,
kpi_time_series array<struct<indicator:string,unit:string,
  time_series:array<struct<period:string,value:string,note:string>>,
  stated_metrics:struct<cagr_stated:string,trend_stated:string,comment:string>,
  target_stated:struct<target_description:string,target_value:string,target_period:string>>>,
logical_relationships array<struct<relationship_type:string,original_text:string,source_section:string,
  confidence:string,subject:string,reason:string,condition:string,consequence:string,
  problem:string,solution:string,premise:string,conclusion:string>>,
segment_time_series array<struct<segment_name:string,
  revenue_time_series:array<struct<period:string,value:string>>,
  profit_time_series:array<struct<period:string,value:string>>,
  stated_metrics:map<string,string>>>
"""

REVIEW_REPLY = """
text_changes map<string,string>, numerical_changes array<string>, tone_analysis map<string,string>,
importance string, importance_reason string, summary string,
contradictions array<string>, normal_differences array<string>, complementary_info array<string>,
consistency_score string, consistency_reason string,
additional_search struct<needed:string,reason:string,search_phrases:array<string>,expected_findings:string>,
_corrupt_record string
"""

# Processing states in their life-cycle order.
PROCESSING_STATES = (
    "queued", "pending_classification", "processing", "extracting_text", "extracting_vision",
    "extracting_tables", "detecting_sections", "extracting_section_content", "structured",
    "completed", "failed", "rejected",
)
# States the report page keeps polling for.
WORKING_STATES = (
    "queued", "processing", "extracting_text", "extracting_vision", "extracting_tables",
    "detecting_sections",
)
# Comparison modes.
CONSISTENCY, BY_COMPANY, BY_YEAR, MULTI = (
    "consistency_check", "diff_analysis_company", "diff_analysis_year", "multi_document",
)
UNKNOWN_TYPE, UNKNOWN_LABEL = "unknown", "未判定"
