"""Schemas of the engine's entities."""

from __future__ import annotations

ITEM = (
    "id string, question string, options array<struct<letter:string,content:string>>, answer array<string>, language string, format string, modality string, "
    "context struct<story:string>, background map<string,string>, images array<string>"
)
CONTEXT_PACK = "text array<string>, images array<string>, style struct<language:string,format:string,modality:string>, tags array<string>, seed_meta struct<id:string,source:string>"
ISSUE = "item_id string, severity string, category string, message string, field string"
SAMPLE = "dataset_name string, split_name string, original_size bigint, sample_size bigint, seed_used bigint, sampled boolean, iteration int"
EXTRACTION = (
    "item_id string, extraction struct<subdomains:array<string>,terms:array<string>,confidence:double,visual_facts:array<string>,native_glosses:map<string,string>,"
    "raw_response:string,is_valid:boolean,anchored_count:int,anchored_fraction:double,tom_categories:array<string>>"
)
ENUM_ENTRY = "id string, name string, aliases array<string>, frequency bigint"
SPLIT = "name string, path string, language string, modality string, expected_size int, has_existing_labels boolean, existing_subdomain_field string"
QUESTION = (
    "id string, dataset string, super_parent string, mid_parent string, subdomain string, design_type string, modality string, language string, question_type string, difficulty string, "
    "question_stem string, options array<string>, answer_text string, answer_set array<string>, answer_explanation string, estimated_time_sec int, requires_image boolean, visual_instruction string, source string"
)
BATCH_LINE = "custom_id string, result struct<type:string,message:struct<content:array<struct<type:string,text:string>>>>"
ANSWER = (
    "dataset string, designer_id string, designer_model string, answer_model_id string, answer_model string, question_id string, generation_index bigint, design_type string, difficulty string, question_type string, "
    "visual_condition string, language string, gold_answer string, raw_output string, parsed_answer string, parsed_set array<string>, scoring_method string, score_details struct<method:string,reason:string>, "
    "is_correct boolean, soft_score double, item_status string, item_quality_flags array<string>, answer_time_ms bigint"
)
