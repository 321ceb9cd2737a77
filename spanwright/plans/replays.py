"""Queries over replays: sessions step by step, and mutations with their lift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, session, whatif
from .catalog import EV, LIMITS, ORACLE_SQL, TR, query
from .lenses import event_traces, keep

#: The hits that a larger k adds to a single hit of k1 / 100, and the scores under each mutation.
LIFTED = f"""{TR}, f AS (SELECT fa.*, k1 / 100 AS m FROM fa),
mu AS (SELECT unnest(['retrieve.top_k', 'retrieve.query_rewrite', 'rerank.reranker', 'generate.context_limit']) AS mutation, unnest([0, 1, 2, 3]) AS number),
sc AS (SELECT f.*, mutation, number, CASE WHEN k1 IS NULL THEN NULL WHEN k1 = 0 THEN 0.0 WHEN number = 0 THEN (m + list_sum(list_transform(range(5), lambda i: round(greatest(0.05, m - 0.05 - i * 0.02), 3)))) / 6 WHEN number = 1 THEN round(least(0.97, m + 0.18), 3) ELSE m END AS m1 FROM f, mu),
gain AS (SELECT trace_id, arg_min(round(round((k - 50) / 100 + 0.08, 4) - (k - 50) / 100, 4), pos) FILTER (WHERE stage = 'rerank') AS g FROM ev GROUP BY trace_id),
aft AS (SELECT sc.trace_id, mutation, number, taxonomy_id AS before, CASE WHEN timeout_stage IS NOT NULL THEN 'F-INFRA-001' WHEN tool_error THEN 'F-TOOL-001' WHEN k1 = 0 THEN 'F-RET-001' WHEN m1 < 0.5 THEN 'F-RET-002' WHEN total_cost > c THEN 'F-INFRA-002' END AS after,
  round(round(m1, 4) - round(m, 4), 4) AS hit_lift, CASE WHEN number = 2 THEN g WHEN g IS NOT NULL THEN 0.0 END AS rerank_lift FROM sc LEFT JOIN gain USING (trace_id)),
att AS (SELECT *, after IS DISTINCT FROM before AS resolved, round(coalesce(hit_lift, 0) + coalesce(rerank_lift, 0), 4) AS total_lift FROM aft)"""

#: A k of 20 is more than the mutation asks for: it changes nothing.
ORACLE_SQL["whatif_all_attempts"] = f"WITH {LIFTED.replace('WHEN number = 0 THEN', 'WHEN false THEN')} SELECT trace_id, mutation, before, after, resolved FROM att"


def _attempts(spark, d):
    traces = keep(event_traces(spark, d, top_k=5), "cohort")
    return whatif.attempts(traces, classify.cost_limit(traces, LIMITS.cost_factor), limits=LIMITS)


@query(f"WITH {LIFTED} SELECT trace_id, mutation, before, after, resolved, hit_lift, rerank_lift, total_lift FROM att")
def whatif_lift(spark, d):
    """Every mutation of every failed trace, with what it changes."""
    rows = _attempts(spark, d)
    return rows.select("trace_id", "mutation", "before", "after", "resolved", F.col("lift.mean_hit_score").alias("hit_lift"), F.col("lift.rerank_delta").alias("rerank_lift"), "total_lift")


@query(f"WITH {LIFTED} SELECT trace_id, arg_min(mutation, (-total_lift, number)) AS mutation, max(total_lift) AS total_lift FROM att WHERE resolved GROUP BY trace_id")
def whatif_best(spark, d):
    return whatif.best(_attempts(spark, d))


@query(f"WITH {EV} SELECT trace_id, count(*)::INT AS step, string_agg(DISTINCT stage, ',' ORDER BY stage) AS stages, sum(k)::BIGINT AS tokens_in, round(sum(cost), 6) AS cost, arg_max(k, pos) FILTER (WHERE stage = 'retrieve')::VARCHAR AS hit_count, arg_max(k, pos) FILTER (WHERE stage = 'embed')::DOUBLE AS token_count FROM ev WHERE pos < 3 GROUP BY trace_id")
def session_states(spark, d):
    """What each session knew after its third step."""
    rows = session.state_at(event_traces(spark, d), 3)
    return rows.select("trace_id", "step", F.array_join("stages", ",").alias("stages"), "tokens_in", "cost", F.col("state")["hit_count"].alias("hit_count"), F.col("state")["token_count"].cast("double").alias("token_count"))


@query(f"WITH {EV}, x AS (SELECT trace_id, pos, stage, k, lag(k) OVER (PARTITION BY trace_id, stage ORDER BY pos) AS old, sum(k) OVER (PARTITION BY trace_id ORDER BY pos) AS tokens_in FROM ev) SELECT trace_id, (pos + 1)::INT AS step, stage, tokens_in::BIGINT AS tokens_in, coalesce(stage = 'retrieve' AND k IS DISTINCT FROM old, false) AS hits_changed FROM x")
def session_steps(spark, d):
    rows = session.steps(event_traces(spark, d))
    return rows.select("trace_id", "step", "stage", "tokens_in", F.map_contains_key("delta", "hit_count").alias("hits_changed"))
