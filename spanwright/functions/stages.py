"""Column builders for names, ids and times of spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import STAGE_ALIASES, STAGES


def normalize_stage(raw: Column) -> Column:
    """An alias gives its stage, else the first alias that is part of the name, else ``tool``."""
    # the key is made once, not for each alias that it is compared with
    return F.transform(F.array(F.regexp_replace(F.lower(F.trim(raw)), "[- ]", "_")), _stage_of)[0]


def _stage_of(key: Column) -> Column:
    out = F.lit("tool")
    for alias, stage in reversed(STAGE_ALIASES.items()):
        out = F.when(F.contains(key, F.lit(alias)), stage).otherwise(out)
    for stage in STAGES:
        out = F.when(key.isin([a for a, s in STAGE_ALIASES.items() if s == stage]), stage).otherwise(out)
    return out


#: Span kinds of the OpenInference convention.
SPAN_KINDS = {"LLM": "generate", "RETRIEVER": "retrieve", "EMBEDDING": "embed", "RERANKER": "rerank", "TOOL": "tool", "AGENT": "agent", "GUARDRAIL": "guard", "CHAIN": "agent"}
#: Keys that only model calls, or only searches, carry.
GENERATE_KEYS = ("gen_ai.prompt", "gen_ai.completion", "gen_ai.usage.input_tokens", "gen_ai.usage.output_tokens", "gen_ai.response.finish_reasons")
RETRIEVE_KEYS = ("retrieval.documents", "retrieval_documents", "match.count", "db.system")
#: Parts of span names; the first list with a hit decides.
NAME_PARTS = (
    (("embed", "embedding"), "embed"),
    (("retriev", "search", "vector", "qdrant", "chroma", "milvus", "pgvector", "pinecone", "weaviate", "hybrid"), "retrieve"),
    (("rerank",), "rerank"),
    (("graph", "knowledge", "kg_"), "graph"),
    (("generate", "generation", "llm", "completion", "chat", "openai", "anthropic", "gpt"), "generate"),
    (("guard", "moderation", "safety"), "guard"),
    (("agent", "planner", "react"), "agent"),
    (("tool", "function", "execute"), "tool"),
)


def infer_stage(name: Column, attrs: Column) -> Column:
    """Stage of a telemetry span from its attributes (a map of strings), or from its name."""
    keys = F.transform(F.map_keys(attrs), F.lower)
    low = F.lower(F.trim(name))
    kinds = F.create_map(*(F.lit(x) for kv in SPAN_KINDS.items() for x in kv))
    kind = F.coalesce(attrs["openinference.span.kind"], attrs["openinference_span_kind"])
    by_name = normalize_stage(name)
    for parts, stage in reversed(NAME_PARTS):
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(low, F.lit(part))
        by_name = F.when(hit, stage).otherwise(by_name)
    by_key = F.when(F.arrays_overlap(keys, F.array(*map(F.lit, GENERATE_KEYS))), "generate").when(F.arrays_overlap(keys, F.array(*map(F.lit, RETRIEVE_KEYS))), "retrieve")
    return F.coalesce(F.when(attrs["stage"].isNotNull(), normalize_stage(attrs["stage"])), kinds[F.upper(kind)], by_key, by_name)


def hex_id(raw: Column) -> Column:
    """Lower-case hex of an id in hex of any case, with or without 0x, or in base64; null if it is neither."""
    plain = F.regexp_replace(F.trim(raw), "^0[xX]", "")
    is_hex = plain.rlike("^[0-9a-fA-F]+$") & (F.length(plain) % 2 == 0)
    return F.when(is_hex, F.lower(plain)).otherwise(F.lower(F.hex(F.try_to_binary(F.nullif(F.trim(raw), F.lit("")), F.lit("base64")))))


def is_root(parent: Column) -> Column:
    return F.coalesce(F.regexp_replace(parent, "0", "") == "", F.lit(True))


def parse_time(raw: Column) -> Column:
    """Timestamp of an ISO text, or of seconds or milliseconds (above 1e11) since 1970 as text."""
    number = F.expr("null").cast("double") if raw is None else raw.try_cast("double")
    seconds = F.when(F.abs(number) > 1e11, number / 1000).otherwise(number)
    return F.coalesce(F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")), raw.try_cast("timestamp"))


def span_status(code: Column, name: Column) -> Column:
    """ok, error or timeout from a telemetry status code (number or name); a name with ``timeout`` decides alone."""
    failed = F.upper(code.cast("string")).isin("2", "ERROR", "STATUS_CODE_ERROR")
    return F.when(F.lower(name).contains("timeout"), "timeout").when(failed, "error").otherwise("ok")
