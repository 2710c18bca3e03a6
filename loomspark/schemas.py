"""Schemas of the retrieval-data model, as Spark DDL."""

CHUNK = "struct<text:string,start:int,end:int,sentence_count:int,word_count:int,chunk_id:int,doc_chunk_index:int,doc_id:string,doc_path:string>"
SEED_DOCUMENTS = f"file_name array<string>, source_id string, text string, chunks array<{CHUNK}>, sections_structured array<string>, bundle_id string, bundle_members array<string>, is_multi_doc boolean"

ARTIFACT_ITEM = "struct<text:string,description:string,importance:string>"
# The kinds of artifacts, in the order of their fields.
ARTIFACT_KINDS = ("key_concepts", "relationships", "themes", "entities", "processes", "insights", "technical_terms", "contextual_factors")
DOCUMENT_ARTIFACTS = "struct<" + ",".join(f"{k}:array<{ARTIFACT_ITEM}>" for k in ARTIFACT_KINDS) + ">"

HOP_CONTEXT = "struct<hop_number:int,segment_ids:array<int>,summary:string>"
QA_PAIR = f"struct<question:string,answer:string,question_complexity:int,query_type:string,reasoning_type:string,segment_ids:array<int>,hop_count:int,hop_contexts:array<{HOP_CONTEXT}>>"
QA_GENERATION = f"struct<pairs:array<{QA_PAIR}>>"
CRITERION = "struct<score:int,justification:string>"
QA_EVALUATION = f"struct<relevance:{CRITERION},accuracy:{CRITERION},context_support:{CRITERION},clarity:{CRITERION},overall:struct<score:double,assessment:string>,improvements:string>"
QA_EVALUATIONS = f"struct<evaluations:array<{QA_EVALUATION}>>"

#: A generated record; file_name is a string or a JSON array of strings until normalised.
RECORD = f"file_name string, source_id string, text string, chunks array<{CHUNK}>, bundle_id string, is_multi_doc boolean, document_artifacts {DOCUMENT_ARTIFACTS}, qa_generation {QA_GENERATION}, deduplicated_qa_pairs array<{QA_PAIR}>, qa_evaluations {QA_EVALUATIONS}"

CODE_FILES = "repo_id string, repo_url string, commit_sha string, source_kind string, repository_path string, source_path string, relative_path string, file_name string, file_extension string, code_lang string, size_bytes bigint, content_sha256 string, content string"

CATALOG = (
    "schema_version int, packages array<struct<name:string,description:string,install:struct<requirement:string,index_url:string>,"
    "compatibility:struct<python:struct<specifier:string>,data_designer:struct<requirement:string,specifier:string,marker:string>>,"
    "docs:struct<url:string>,plugins:array<struct<name:string,plugin_type:string,entry_point:struct<group:string,name:string,value:string>>>>>"
)
PACKAGE_LIST = "filename string, hash string, requires_python string"

# Kinds of questions and of reasoning.
QUERY_TYPES = ("multi_hop", "structural", "contextual")
REASONING_TYPES = ("factual", "relational", "inferential", "temporal", "procedural", "visual", "causal")
