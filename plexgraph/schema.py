"""Table schemas, the closed type ontology and other fixed values."""

from __future__ import annotations

ENTITIES = "collection string, name string, type string, description string, aliases array<string>"
RELATIONS = "collection string, source string, target string, predicate string, valid_from string, source_doc string"
SAME_AS = "collection_lo string, name_lo string, collection_hi string, name_hi string"
DOCUMENTS = "source_id string, collection string, file_name string, content string, content_hash string, last_modified timestamp"
CHUNKS = "collection string, source_id string, chunk_idx int, text string, embedding array<float>"
BLACKLIST = "collection string, node_a string, node_b string, reason string"
HIERARCHY = "collection string, parent string"
CANDIDATES = "collection string, entity_name string, source_doc string, description string"
COMMUNITIES = "collection string, community_id string, level int, parent_community_id string, entity_names array<string>, size int, graph_signature string"
BUILD_STATE = "collection string, dirty boolean, graph_signature string"
REPORTS = "collection string, community_id string, level int, title string, summary string, rating double, content_signature string, updated_at timestamp"
PROGRESS = "collection string, file_name string, source_id string, content_hash string, total_chunks int, done_chunks int"
USAGE = "usage_date date, request_count bigint"

TABLES = {
    "entities": ENTITIES, "relations": RELATIONS, "same_as": SAME_AS, "documents": DOCUMENTS, "chunks": CHUNKS, "merge_blacklist": BLACKLIST, "collection_meta": HIERARCHY,
    "entity_desc_candidates": CANDIDATES, "communities": COMMUNITIES, "community_build_state": BUILD_STATE, "community_reports": REPORTS, "ingest_progress": PROGRESS, "api_usage": USAGE,
}

#: The ontology, and which type wins where two passes disagree (lower wins, ties go to the first).
ENTITY_TYPES = ("PERSON", "ORGANIZATION", "LOCATION", "EVENT", "WORK", "CONCEPT", "OBJECT", "DATE", "OTHER")
TYPE_PRIORITY = {"PERSON": 0, "ORGANIZATION": 0, "LOCATION": 0, "OBJECT": 1, "WORK": 1, "CONCEPT": 1, "EVENT": 1, "DATE": 2, "OTHER": 2}

#: Predicates that extraction prompts suggest.
SEED_PREDICATES = (
    "WORKS_AT", "MEMBER_OF", "PART_OF", "LOCATED_IN", "OWNS", "MANAGES", "CREATED", "PRODUCES", "USES", "PARTICIPATED_IN", "OCCURRED_ON", "HAS_ROLE", "AFFILIATED_WITH", "CAUSES", "RELATED_TO",
    "FOUNDED", "ACQUIRED", "MERGED_WITH", "SPUN_OFF", "HOLDS_STAKE", "OPERATES", "PARENT_OF", "SPOUSE_OF", "BETROTHED_TO", "SIBLING_OF", "WORKS_FOR", "LIVES_IN", "FRIEND_OF", "LIKES", "CONFLICTS_WITH", "PROMISED_TO",
)

#: Units that make a name a mere number, case particles, first-person words.
NUMBER_UNITS = ("퍼센트", "시간", "억", "조", "만", "천", "백", "원", "달러", "명", "개", "주", "건", "회", "배", "위", "년", "월", "일", "시", "분", "초", "%")
PARTICLES = ("이", "가", "은", "는", "을", "를", "과", "와")
FIRST_PERSON = ("나", "내", "저")
NARRATOR = "화자"

#: The label of a numbered text in a prompt, and the note on calls that failed.
TEXT_LABEL = "[본문 {}]"
FAILED_CALLS = "\n\n※ MAP 호출 {}/{}건이 실패했습니다 — 로그를 확인하세요."

#: Backends for which the automatic extraction mode is the decomposed one.
DECOMPOSED_BACKENDS = ("ollama", "claude_cli", "codex_cli")
