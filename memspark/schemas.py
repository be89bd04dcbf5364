"""Declared schemas of the memory tables; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

SCOPE_DDL = "scope_kind string, scope_owner string"
REF_DDL = "array<struct<kind:string,scope:struct<kind:string,owner:string>,id:string>>"

DDL = {
    "episodes": f"""id string, ts timestamp, type string, provider_vendor string, provider_model string, context_tags array<string>,
        input_text string, output_text string, note string, importance double, hash string, truncated boolean, memory_gate string,
        retrieved_refs {REF_DDL}, refers_to string, rating string, embedding array<float>, embedding_model string, {SCOPE_DDL}, key_version int""",
    "summaries": f"""id string, period string, level string, status string, source_episode_ids array<string>, source_summary_periods array<string>,
        summary string, entities_touched array<string>, grounding_checked boolean, supersedes string, correction_reason string, created_at timestamp,
        embedding array<float>, embedding_model string, {SCOPE_DDL}, key_version int""",
    "summary_key_facts": f"""id bigint, summary_id string, fact string, source_episode_ids array<string>, grounded boolean, embedding array<float>,
        embedding_model string, expires_at date, expire_reason string, source_count int, is_inference boolean, {SCOPE_DDL}""",
    "entities": f"""{SCOPE_DDL}, id string, kind string, name string, first_seen date, last_updated date, attributes map<string,string>,
        embedding array<float>, embedding_model string""",
    "entity_relationships": f"""id string, {SCOPE_DDL}, subject_id string, predicate string, object_id string, valid_from date, valid_until date,
        source_summary_id string, created_at timestamp""",
    "memories": f"""id string, {SCOPE_DDL}, entity_id string, attribute_key string, summary_id string, content string, is_static boolean,
        is_inference boolean, source_count int, expires_at date, grounded boolean, supersedes string, embedding array<float>""",
    "memory_relations": f"id string, {SCOPE_DDL}, from_memory_id string, to_memory_id string, relation_type string",
    "audit_log": f"id bigint, ts timestamp, event_type string, actor string, {SCOPE_DDL}, target_ref string, detail string",
    "key_rotations": f"{SCOPE_DDL}, from_version int, to_version int, status string, started_at timestamp, completed_at timestamp",
    "demo_sessions": f"id string, {SCOPE_DDL}, created_at timestamp, expires_at timestamp",
}

# Records of the portable bundle.
BUNDLE_DDL = {
    "episodes": f"""id string, ts timestamp, type string, provider_vendor string, provider_model string, input_text string, output_text string,
        importance double, hash string, truncated boolean, memory_gate string, retrieved_refs {REF_DDL}, refers_to string, rating string, note string,
        context_tags array<string>""",
    "summaries": """id string, period string, level string, status string, generated_by_vendor string, generated_by_model string,
        source_episode_ids array<string>, source_summary_periods array<string>, summary string, entities_touched array<string>, grounding_checked boolean,
        supersedes string, correction_reason string, created_at timestamp, key_facts array<struct<fact:string,source_episode_ids:array<string>,
        grounded:boolean,source_count:int,expires_at:string,expire_reason:string,is_inference:boolean>>""",
    "entities": "id string, kind string, name string, first_seen timestamp, last_updated timestamp, attributes map<string,string>",
    "memory_relations": """relation_type string, from struct<summary_id:string,fact:string,entity_id:string,attribute_key:string>,
        to struct<summary_id:string,fact:string,entity_id:string,attribute_key:string>""",
}
MANIFEST_DDL = """created_at timestamp, created_by string, scopes array<struct<scope_kind:string,scope_owner:string,dir:string,episode_count:bigint,
    summary_count:bigint,entity_count:bigint,memory_relation_count:bigint,earliest_episode_at:timestamp,latest_episode_at:timestamp>>"""


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
