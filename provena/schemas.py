"""Explicit schemas of everything that is read or written, as DDL. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


DECLARATION = (
    "org string, doc_id string, title string, organization string, countries array<string>, publication_date string, "
    "url string, doc_type string, source_format string, topics array<string>, language string, "
    "selection_rationale string, corpus_version string, sha256 string, acquisition string"
)
ORG = ("org string, default_acquisition string, raw_bytes_stable boolean")
MANIFEST = (
    "doc_id string, org string, title string, countries string, publication_date string, sha256 string, local_path string"
)
CHECKSUM_FIELD = ("org string, doc_id string, field string, value string")
PAGE_BREAKPOINTS = ("doc_id string, pages array<struct<page:int,char_start:int,char_end:int>>")
VALIDATION = (
    "doc_id string, org string, tier1 struct<extraction_ok:boolean,integrity_ok:boolean>, tier1_passed boolean, "
    "tier1_reason string, tier2 struct<word_count:int,language:string,language_confidence:double,language_ok:boolean,"
    "length_ok:boolean,near_duplicates:bigint,content_drift:struct<drifted:boolean,expected:string,actual:string>>, "
    "tier2_flags array<string>, topic_hints array<string>"
)
_DECLARED = (
    "struct<title:string,organization:string,countries:array<string>,publication_date:string,url:string,doc_type:string,"
    "source_format:string,topics:array<string>,language:string,selection_rationale:string,corpus_version:string>"
)
_DERIVED = (
    "struct<sha256:string,file_size_bytes:bigint,extracted_word_count:int,extraction_method:string,extraction_date:string,"
    "detected_language:string,detected_language_confidence:double,validation_status:string,validation_warnings:array<string>>"
)
_LIFECYCLE = "struct<status:string,superseded_by:string,supersedes:string,reason:string,effective_date:string>"
_CHUNKING = (
    "struct<strategy:string,chunk_size:int,chunk_step:int,total_chunks:int,chunking_date:string,corpus_version:string>"
)
METADATA = (
    f"doc_id string, schema_version string, declared {_DECLARED}, derived {_DERIVED}, lifecycle {_LIFECYCLE}, "
    f"chunking {_CHUNKING}"
)
CHUNK = (
    "chunk_id string, doc_id string, chunk_index int, char_start int, char_end int, text string, pages array<int>, "
    f"document_metadata struct<declared:{_DECLARED},derived:{_DERIVED},lifecycle:{_LIFECYCLE},chunking:{_CHUNKING}>"
)
INDEX_STAMP = (
    "embedding_model string, embedding_dim int, corpus_version string, chunk_count bigint, created_at string"
)
QUESTION = (
    "question string, correct_chunk_id string, doc_id string, organization string, category string"
)
ANSWER = (
    "question_id string, question string, category string, expected_behavior string, answer_markdown string, "
    "citations array<struct<marker:int,chunk_id:string,doc_id:string,pages:array<int>>>, invalid_markers array<int>, "
    "unsupported_paragraphs array<string>, sourcing struct<distinct_orgs:int,distinct_docs:int,footer:string>, "
    "usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>, retrieved_chunks map<string,string>, "
    "n_retrieved int, rationale string"
)
JUDGMENT = (
    "judgment_id string, question_id string, category string, claim_text string, markers array<int>, "
    "cited_chunk_texts array<string>, verdict string, reason string, prompt_version string"
)
INTERACTION = (
    "id bigint, ts timestamp, query string, rewritten_query string, answer_markdown string, latency_ms int, "
    "retrieval_ms int, llm_ms int, prompt_tokens int, completion_tokens int, total_tokens int, model string, "
    "est_cost_usd decimal(10,6), retrieval_method string, top_k int, n_chunks int, retrieval_scores array<double>, "
    "citations_summary array<struct<marker:int,doc_id:string,org:string,score:double>>, source_orgs array<string>, "
    "citation_count int, sourcing_status string, distinct_org_count int, distinct_doc_count int, "
    "invalid_marker_count int, unsupported_paragraph_count int, feedback smallint, feedback_at timestamp"
)
FEEDBACK = ("id bigint, value smallint, at timestamp")
DECISION = ("doc_id string, kind string, reason string, at string")
RRF_CONFIG = ("method string, rrf_k int")


def fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Additive schema evolution: columns the data lacks become null, types follow the schema."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields(ddl)
        ]
    )
