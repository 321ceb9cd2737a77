"""The trace model: one row per request, its spans as an ordered array of structs."""

from __future__ import annotations

ATTRS = (
    "query string, top_k int, hit_count int, hit_scores array<double>, mean_hit_score double, rerank_top1 double, rerank_delta double, "
    "token_count double, model string, prompt_chars int, finish_reason string, output string, context string, output_format string, blocked boolean, error string"
)
SPAN = f"pos int, span_id string, parent_id string, name string, stage string, duration_ms double, status string, tokens_in bigint, tokens_out bigint, cost double, attrs struct<{ATTRS}>"
TRACES = f"trace_id string, ts timestamp, day date, pipeline_name string, total_cost double, spans array<struct<{SPAN}>>"
ATTR_NAMES = tuple(x.split()[0] for x in ATTRS.split(", "))

#: Stages in the order in which reports list them.
STAGES = ("embed", "retrieve", "rerank", "graph", "generate", "guard", "tool", "agent")

#: Other names of stages; the order decides where several are part of one name.
STAGE_ALIASES = {
    "embed": "embed",
    "embedding": "embed",
    "embeddings": "embed",
    "retrieve": "retrieve",
    "retrieval": "retrieve",
    "hybrid": "retrieve",
    "hybrid_retrieve": "retrieve",
    "search": "retrieve",
    "vector_search": "retrieve",
    "rerank": "rerank",
    "reranker": "rerank",
    "cross_encoder": "rerank",
    "graph": "graph",
    "graphrag": "graph",
    "kg": "graph",
    "generate": "generate",
    "generation": "generate",
    "llm": "generate",
    "answer": "generate",
    "guard": "guard",
    "guardrail": "guard",
    "guardrails": "guard",
    "tool": "tool",
    "tool_call": "tool",
    "agent": "agent",
    "react": "agent",
}

#: Failure classes with the stage that each points to.
TAXONOMY = {
    "F-RET-001": ("Retrieval found nothing", "retrieve"),
    "F-RET-002": ("Retrieval found weak matches", "retrieve"),
    "F-RET-003": ("Retrieval scores decline over time", "retrieve"),
    "F-PROMPT-001": ("Prompt filled the context", "generate"),
    "F-GEN-001": ("Output is not the JSON it should be", "generate"),
    "F-GEN-002": ("Output repeats itself", "generate"),
    "F-GEN-003": ("Refusal in spite of usable context", "generate"),
    "F-GEN-004": ("Claims without support", "generate"),
    "F-TOOL-001": ("Tool call failed", "tool"),
    "F-INFRA-001": ("A stage ran out of time", "generate"),
    "F-INFRA-002": ("Request cost far above its cohort", "generate"),
    "F-INFRA-003": ("Blocked or broken outside the rules", "guard"),
}

#: What is known to help against each class.
PLAYBOOKS = {
    "F-RET-001": "widen or rewrite the query, and answer from a fallback when nothing is found",
    "F-RET-002": "raise the score that context must have, or rerank before generating",
    "F-RET-003": "compare the index with its last good state and embed it anew",
    "F-PROMPT-001": "trim or summarise the context before it is sent",
    "F-GEN-001": "validate the output against its schema and ask once more with the error",
    "F-GEN-002": "raise the repetition penalty or stop at the first repeated passage",
    "F-GEN-003": "tell the model that the context suffices, and test the prompt on past refusals",
    "F-GEN-004": "ask for citations and drop sentences that no source supports",
    "F-TOOL-001": "hand the tool's error to the model and bound its retries",
    "F-INFRA-001": "set a deadline for each stage and a cheaper stage to fall back to",
    "F-INFRA-002": "set a budget for each request and stop loops that exceed it",
    "F-INFRA-003": "review the guard's rule on this request and allow it or document the block",
}

#: A check that would have seen a failure of each class.
EXPECTED_GUARDS = {
    "F-RET-001": "ask back when a search finds nothing",
    "F-RET-002": "compare the scores with those of requests that went well",
    "F-RET-003": "search for known questions each night and watch their scores",
    "F-PROMPT-001": "count the tokens of a prompt before it is sent",
    "F-GEN-001": "parse what comes back and reject what does not parse",
    "F-GEN-002": "stop writing when the same words come round again",
    "F-GEN-003": "notice answers that decline although passages were found",
    "F-GEN-004": "look up each sentence of an answer in its passages",
    "F-TOOL-001": "read a tool's result before it is used",
    "F-INFRA-001": "give each stage a time after which it is cut off",
    "F-INFRA-002": "give each request a sum that it may spend",
    "F-INFRA-003": "have a person look at what guards block",
}
