"""The registered queries and the SQL that gives the same rows on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stages, stats, text
from ..functions.rules import Limits, ambiguity, fallback
from ..operators import ambiguous, blame, chain, classify, cluster, drift, health, incident, replay, report, whatif
from ..sources import otlp
from .lenses import conversation_answers, event_spans, event_traces, keep, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LIMITS = Limits(cost_factor=1.5)  # the stock factor of 3 flags nothing in ``events``
BASE, DAYS, H = 14, 3, 1.5

EV = """ev AS (SELECT *, CASE event_type WHEN 'signup' THEN 'embed' WHEN 'view' THEN 'retrieve' WHEN 'click' THEN 'rerank' WHEN 'purchase' THEN 'generate' ELSE 'tool' END AS stage,
  CASE WHEN value > 200 THEN 'timeout' WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, value / 1000 AS cost,
  row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) - 1 AS pos
  FROM (SELECT event_id, ts, ts::DATE AS day, user_id, event_type, value, (props->>'$.k')::BIGINT AS k, user_id::VARCHAR || '-' || (ts::DATE)::VARCHAR AS trace_id FROM events))"""
TR = f"""{EV},
tr AS (SELECT trace_id, day, sum(cost) AS total_cost, arg_min(stage, pos) FILTER (WHERE status = 'timeout') AS timeout_stage, bool_or(stage = 'tool' AND status = 'error') AS tool_error,
  arg_min(k, pos) FILTER (WHERE stage = 'retrieve') AS k1, arg_min(pos, pos) FILTER (WHERE stage = 'retrieve') AS pos1, min(pos) FILTER (WHERE stage = 'tool') AS tool_pos FROM ev GROUP BY trace_id, day),
lim AS (SELECT CASE WHEN count(*) >= 20 THEN greatest(1e-6, 1.5 * quantile_cont(total_cost, 0.95)) END AS c FROM tr WHERE total_cost > 0),
fl AS (SELECT *, CASE WHEN timeout_stage IS NOT NULL THEN 'F-INFRA-001' WHEN tool_error THEN 'F-TOOL-001' WHEN k1 = 0 THEN 'F-RET-001' WHEN k1 < 50 THEN 'F-RET-002' WHEN total_cost > lim.c THEN 'F-INFRA-002' END AS taxonomy_id,
  CASE WHEN timeout_stage IS NOT NULL THEN timeout_stage WHEN tool_error THEN 'tool' WHEN k1 < 50 THEN 'retrieve' ELSE 'generate' END AS failed FROM tr, lim),
fa AS (SELECT * FROM fl WHERE taxonomy_id IS NOT NULL)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _failures(spark: SparkSession, d: str) -> DataFrame:
    return classify.failures(keep(event_traces(spark, d), "cohort"), LIMITS)


@query(f"WITH {TR} SELECT day, taxonomy_id, count(*) AS n FROM fa GROUP BY ALL")
def failure_mix_per_day(spark, d):
    return classify.mix_per_day(_failures(spark, d))


@query(f"WITH {TR} SELECT taxonomy_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM fa GROUP BY taxonomy_id")
def failure_mix(spark, d):
    return classify.mix(_failures(spark, d)).withColumn("share", F.round("share", 6))


@query(f"WITH {TR} SELECT trace_id, day, taxonomy_id, failed AS stage, CASE taxonomy_id WHEN 'F-TOOL-001' THEN 0.9 WHEN 'F-RET-002' THEN 0.85 WHEN 'F-INFRA-002' THEN 0.85 ELSE 0.95 END::DOUBLE AS confidence FROM fa")
def classify_precedence(spark, d):
    return _failures(spark, d).select("trace_id", "day", "taxonomy_id", "stage", "confidence")


@query(f"WITH {TR} SELECT round(c, 6) AS cost_limit FROM lim")
def cost_threshold_p95(spark, d):
    return classify.cost_limit(event_traces(spark, d), 1.5).select(F.round("cost_limit", 6).alias("cost_limit"))


@query(f"WITH {TR} SELECT trace_id, round(total_cost, 6) AS total_cost FROM tr, lim WHERE total_cost > c")
def cost_spike(spark, d):
    t = event_traces(spark, d)
    return t.crossJoin(F.broadcast(classify.cost_limit(t, 1.5))).where("total_cost > cost_limit").select("trace_id", F.round("total_cost", 6).alias("total_cost"))


@query(f"WITH {EV}, g AS (SELECT trace_id, bool_or(stage = 'generate' AND status = 'ok') AS blank, bool_or(stage <> 'tool' AND status = 'error') AS bad FROM ev GROUP BY trace_id) SELECT trace_id, concat_ws(',', CASE WHEN blank THEN 'empty_output' END, CASE WHEN bad THEN 'span_error' END) AS signals FROM g WHERE blank OR bad")
def ambiguity_signals(spark, d):
    rows = event_traces(spark, d).select("trace_id", F.array_join(ambiguity(F.col("spans")), ",").alias("signals"))
    return rows.where("signals <> ''")


@query(f"WITH {EV} SELECT trace_id, 'F-GEN-001' AS taxonomy_id, 'generate' AS stage FROM ev GROUP BY trace_id HAVING bool_or(stage = 'generate' AND status = 'ok')")
def fallback_verdict(spark, d):
    rows = event_traces(spark, d).select("trace_id", fallback(F.col("spans")).alias("v")).where("v is not null")
    return rows.select("trace_id", "v.taxonomy_id", "v.stage")


@query(f"WITH {EV} SELECT stage, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(avg((status <> 'ok')::INT), 6) AS error_rate, CASE WHEN avg((status <> 'ok')::INT) >= 0.2 THEN 'crit' WHEN avg((status <> 'ok')::INT) >= 0.05 THEN 'warn' ELSE 'ok' END AS status FROM ev GROUP BY stage")
def stage_cards(spark, d):
    rows = health.stage_cards(event_spans(spark, d))
    return rows.select("stage", "n", *(F.round(c, 6).alias(c) for c in ("p50_ms", "p95_ms", "error_rate")), "status")


@query(f"WITH {TR} SELECT round(avg((k1 > 0)::INT), 6) AS hit_rate, round(avg(k1 / 100) FILTER (WHERE k1 > 0), 6) AS mean_score, round(avg(least(1, k1 / 20)), 6) AS k_coverage, count(*) AS n FROM tr WHERE k1 IS NOT NULL")
def retrieve_card(spark, d):
    return health.retrieve_card(event_traces(spark, d)).select(*(F.round(c, 6).alias(c) for c in ("hit_rate", "mean_score", "k_coverage")), "n")


@query(f"WITH {EV} SELECT round(avg((k - 50) / 100), 6) AS mean_delta, count(*) AS n FROM ev WHERE stage = 'rerank'")
def rerank_card(spark, d):
    return health.rerank_card(health.spans_of(event_traces(spark, d))).select(F.round("mean_delta", 6).alias("mean_delta"), "n")


@query(f"WITH {EV} SELECT round(avg(k), 6) AS mean_tokens, round(stddev_pop(k), 6) AS std_tokens, count(*) AS n FROM ev WHERE stage = 'embed'")
def embed_card(spark, d):
    return health.embed_card(health.spans_of(event_traces(spark, d))).select(F.round("mean_tokens", 6).alias("mean_tokens"), F.round("std_tokens", 6).alias("std_tokens"), "n")


@query(f"""WITH {TR}, h AS (SELECT trace_id, sum(value) AS total_ms, max(value) AS slowest_ms, sum((status <> 'ok')::INT) AS errors, CASE WHEN bool_or(stage = 'generate') THEN 0.0::DOUBLE END AS groundedness, arg_min((k - 50) / 100, pos) FILTER (WHERE stage = 'rerank') AS rerank_delta FROM ev GROUP BY trace_id)
  SELECT trace_id, round(total_ms, 6) AS total_ms, slowest_ms, errors::INT AS errors, CASE WHEN k1 > 0 THEN round(k1 / 100, 6) END AS mean_score, CASE WHEN pos1 IS NOT NULL THEN round(k1 / 100, 4) END AS mean_hit_score, groundedness, round(rerank_delta, 6) AS rerank_delta FROM h JOIN tr USING (trace_id)""")
def trace_health(spark, d):
    return health.trace_health(event_traces(spark, d)).select("trace_id", F.round("total_ms", 6).alias("total_ms"), "slowest_ms", "errors", F.round("mean_score", 6).alias("mean_score"), "mean_hit_score", "groundedness", F.round("rerank_delta", 6).alias("rerank_delta"))


_CONTENT = "list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+(?:\\.[a-z0-9]+)?'), lambda t: NOT list_contains(stop, t) AND (length(t) > 2 OR regexp_matches(t, '[0-9]')))"
_ENTITY = "list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace({x}, '[\\p{{L}}\\p{{N}}_]*[^\\P{{L}}a-zA-Z][\\p{{L}}\\p{{N}}_]*', 'x', 'g'), '\\b[A-Z][a-zA-Z0-9-]{{2,}}\\b'), lambda t: lower(t)), lambda t: NOT list_contains(stop, t)))"
_NO = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+(?:\\.[a-z0-9]+)?'), lambda t: list_contains(neg, t)))"
_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
GROUNDED = rf"""WITH c AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ctx FROM conversations),
a AS (SELECT conv_id, turn, coalesce(text, '') AS o, coalesce(ctx, '') AS x, {_LIST(text.STOPWORDS)} AS stop, {_LIST(text.NEGATIONS)} AS neg FROM c WHERE role = 'assistant'),
k AS (SELECT *, list_concat({_CONTENT.format(x="x")}, {_ENTITY.format(x="x")}) AS known, {_NO.format(x="x")} AS no FROM a),
s AS (SELECT conv_id, turn, known, no, stop, neg, unnest(regexp_split_to_array(regexp_replace(o, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')) AS s FROM k WHERE trim(o) <> '' AND trim(x) <> ''),
t AS (SELECT *, {_CONTENT.format(x="s")} AS toks, {_ENTITY.format(x="s")} AS names, {_NO.format(x="s")} AS denied FROM s),
p AS (SELECT conv_id, turn, greatest(0, least(1, 1 - least(1, list_sum(list_transform(toks, lambda w: CASE WHEN list_contains(known, w) THEN 0 WHEN regexp_matches(w, '[0-9]') OR list_contains(names, w) THEN 2 ELSE 1 END))
  / greatest(1, len(toks) + len(list_filter(names, lambda n: NOT list_contains(known, n))))) - 0.25 * len(list_filter(denied, lambda n: NOT list_contains(no, n))))) AS v FROM t WHERE len(toks) > 0)
SELECT a.conv_id, a.turn, round(coalesce(avg(v), 0), 6)::DOUBLE AS groundedness FROM a LEFT JOIN p ON a.conv_id = p.conv_id AND a.turn = p.turn GROUP BY a.conv_id, a.turn"""


@query(GROUNDED)
def groundedness_scores(spark, d):
    return conversation_answers(spark, d).select("conv_id", "turn", F.round(text.groundedness(F.col("output"), F.col("context")), 6).alias("groundedness"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
g AS (SELECT doc_id, list_slice(w, i, i + 2) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
c AS (SELECT doc_id, x, count(*) AS n FROM g GROUP BY doc_id, x) SELECT doc_id, max(n)::INT AS repeats FROM c GROUP BY doc_id HAVING max(n) >= 5""")
def repetition_loop(spark, d):
    return table(spark, d, "documents").select("doc_id", text.repeated_trigrams(F.col("text")).alias("repeats")).where("repeats >= 5")


@query(f"""SELECT conv_id, turn, list_filter({_LIST(text.REFUSALS)}, lambda p: contains(lower(text), p))[1] AS phrase FROM conversations WHERE role = 'assistant'""")
def refusal_scan(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", text.refusal(F.col("text")).alias("phrase"))


_KW = ", ".join(f"({_LIST(ws)}, '{c}')" for c, ws in classify.KEYWORDS.items())


@query(f"""WITH kw AS (SELECT * FROM (VALUES {_KW}) v(words, id)), s AS (SELECT doc_id, id, list_sum(list_transform(words, lambda w: (length(lower(text)) - length(replace(lower(text), w, ''))) // length(w))) AS n FROM documents, kw)
SELECT doc_id, arg_min(id, (-n, id)) AS taxonomy_id, round(least(0.75, 0.40 + 0.05 * max(n)), 6)::DOUBLE AS confidence FROM s GROUP BY doc_id HAVING max(n) > 0""")
def keyword_score(spark, d):
    rows = classify.keyword_verdicts(table(spark, d, "documents"), "doc_id", F.col("text"))
    return rows.select("doc_id", "v.taxonomy_id", F.round("v.confidence", 6).cast("double").alias("confidence"))


def _stage_sql() -> str:
    from ..schema import STAGE_ALIASES

    exact = " ".join(f"WHEN x = '{a}' THEN '{s}'" for a, s in STAGE_ALIASES.items())
    part = " ".join(f"WHEN contains(x, '{a}') THEN '{s}'" for a, s in STAGE_ALIASES.items())
    return f"WITH n AS (SELECT DISTINCT event_type AS raw FROM events UNION SELECT DISTINCT p_name FROM part UNION SELECT unnest(['LLM', ' Vector-Search ', 'cross encoder', 'background', 'rerank_search', 'ReAct loop'])), k AS (SELECT raw, replace(replace(lower(trim(raw)), '-', '_'), ' ', '_') AS x FROM n) SELECT raw, CASE {exact} {part} ELSE 'tool' END AS stage FROM k"


@query(_stage_sql())
def stage_normalise(spark, d):
    extra = spark.createDataFrame([(x,) for x in ("LLM", " Vector-Search ", "cross encoder", "background", "rerank_search", "ReAct loop")], "raw string")
    names = table(spark, d, "events").select(F.col("event_type").alias("raw")).union(table(spark, d, "part").select("p_name")).union(extra).distinct()
    return names.select("raw", stages.normalize_stage(F.col("raw")).alias("stage"))


@query(f"WITH {EV} SELECT trace_id, event_id, (pos + 1)::INT AS step, sum(k) OVER w::BIGINT AS tokens_in_sum, round(sum(cost) OVER w, 6) AS cost_sum FROM ev WINDOW w AS (PARTITION BY trace_id ORDER BY pos ROWS UNBOUNDED PRECEDING)")
def running_totals(spark, d):
    rows = replay.running_totals(event_spans(spark, d).withColumn("tokens_in", F.col("k")).withColumn("tokens_out", F.lit(0)))
    return rows.select("trace_id", "event_id", "step", "tokens_in_sum", F.round("cost_sum", 6).alias("cost_sum"))


_STATES = "s AS (SELECT l_orderkey, l_linenumber, unnest(['flag', 'status', 'part']) AS name, unnest([l_returnflag, l_linestatus, l_partkey::VARCHAR]) AS value FROM lineitem)"


def _states(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_partkey").alias("part"))
    return replay.long_form(rows, ["l_orderkey", "l_linenumber"], ["flag", "status", "part"])


@query(f"WITH {_STATES}, b AS (SELECT *, lag(value) OVER (PARTITION BY l_orderkey, name ORDER BY l_linenumber, value) AS old FROM s) SELECT l_orderkey, l_linenumber, name, value FROM b WHERE old IS DISTINCT FROM value")
def state_delta(spark, d):
    return replay.state_delta(_states(spark, d), "l_orderkey", "l_linenumber")


@query(f"WITH {_STATES} SELECT l_orderkey, name, arg_max(value, (l_linenumber, value)) AS value FROM s WHERE l_linenumber < 3 GROUP BY ALL")
def state_at_n(spark, d):
    return replay.state_at(_states(spark, d), 3, "l_orderkey", "l_linenumber")


@query("WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events), m AS (SELECT day, datediff('day', min(day) OVER (), day) + 1 AS i FROM d) SELECT day, i::INT AS day_index, ((i - 1) // 7)::INT AS section FROM m")
def day_index_sections(spark, d):
    days = table(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    i = F.date_diff("day", F.min("day").over(Window.partitionBy(F.lit(0)))) + 1  # a row for each day
    return days.select("day", i.alias("day_index"), F.floor((i - 1) / 7).cast("int").alias("section"))


_SIGNALS = f"""{TR},
raw AS (SELECT trace_id, stage, pos, unnest(CASE stage WHEN 'embed' THEN [{{'g': 'duration_ms', 'spec': 0, 'up': 1, 'v': value}}, {{'g': 'token_count', 'spec': 1, 'up': 1, 'v': k::DOUBLE}}]
  WHEN 'retrieve' THEN [{{'g': 'hit_count', 'spec': 2, 'up': -1, 'v': k::DOUBLE}}, {{'g': 'mean_hit_score', 'spec': 3, 'up': -1, 'v': CASE WHEN k > 0 THEN k / 100 END}}, {{'g': 'duration_ms', 'spec': 4, 'up': 1, 'v': value}}]
  WHEN 'rerank' THEN [{{'g': 'rerank_delta', 'spec': 5, 'up': -1, 'v': (k - 50) / 100}}, {{'g': 'duration_ms', 'spec': 6, 'up': 1, 'v': value}}]
  WHEN 'generate' THEN [{{'g': 'duration_ms', 'spec': 8, 'up': 1, 'v': value}}, {{'g': 'tokens_in', 'spec': 10, 'up': 1, 'v': k::DOUBLE}}, {{'g': 'tokens_out', 'spec': 11, 'up': 0, 'v': 0.0::DOUBLE}}, {{'g': 'cost', 'spec': 12, 'up': 1, 'v': cost}}]
  ELSE [{{'g': 'duration_ms', 'spec': 14, 'up': 1, 'v': value}}] END) AS x FROM ev),
sg AS (SELECT trace_id, stage, pos, x.g AS signal, x.spec AS spec, x.up AS up, x.v AS v FROM raw WHERE x.v IS NOT NULL),
bl AS (SELECT stage, signal, avg(v) AS mean, stddev_pop(v) AS std FROM sg WHERE trace_id NOT IN (SELECT trace_id FROM fa) GROUP BY stage, signal HAVING avg(v) <> 0 OR stddev_pop(v) <> 0),
zs AS (SELECT sg.*, taxonomy_id, failed, (v - mean) / std * up AS z FROM sg JOIN bl USING (stage, signal) JOIN fa USING (trace_id)),
bz AS (SELECT *, row_number() OVER (PARTITION BY trace_id, stage ORDER BY round(z, 9) DESC, pos, spec) AS rn FROM zs WHERE z > 0),
cd AS (SELECT trace_id, taxonomy_id, stage, signal, round(z, 4) AS z_score, round(z + CASE WHEN stage = failed THEN 1.5 ELSE 0 END, 4) AS score, list_position(['embed', 'retrieve', 'rerank', 'graph', 'generate', 'guard', 'tool', 'agent'], stage) AS so FROM bz WHERE rn = 1),
tp AS (SELECT fa.trace_id, fa.taxonomy_id, coalesce(arg_min(cd.stage, (-score, so)), any_value(failed)) AS stage FROM fa LEFT JOIN cd USING (trace_id) GROUP BY fa.trace_id, fa.taxonomy_id)"""


def _blame(spark, d):
    t = keep(event_traces(spark, d), "cohort")
    f = keep(classify.failures(t, LIMITS), "failures")
    return t, f, keep(blame.baseline(t, f), "baseline")


@query(f"WITH {_SIGNALS} SELECT stage, signal, round(mean, 6) AS mean, round(std, 6) AS std FROM bl")
def baseline_stats(spark, d):
    return _blame(spark, d)[2].select("stage", "signal", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {_SIGNALS} SELECT trace_id, stage, signal, z_score FROM cd")
def zscore_anomaly(spark, d):
    return blame.candidates(*_blame(spark, d)).select("trace_id", "stage", "signal", "z_score")


@query(f"WITH {_SIGNALS} SELECT trace_id, taxonomy_id, stage FROM tp")
def blame_top1(spark, d):
    return blame.top_stage(*_blame(spark, d))


@query(f"WITH {_SIGNALS} SELECT taxonomy_id, stage, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY taxonomy_id), 6) AS share FROM tp GROUP BY taxonomy_id, stage")
def cohort_blame(spark, d):
    return blame.cohort_shares(blame.top_stage(*_blame(spark, d))).withColumn("share", F.round("share", 6))


@query(f"WITH {_SIGNALS} SELECT stage, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM tp GROUP BY stage")
def weighted_blame(spark, d):
    return blame.weighted_shares(blame.top_stage(*_blame(spark, d))).withColumn("share", F.round("share", 6))


_GRID = f"""{TR}, dn AS (SELECT day, taxonomy_id, count(*) AS n FROM fa GROUP BY ALL), dy AS (SELECT day, row_number() OVER (ORDER BY day) AS day_idx FROM (SELECT DISTINCT day FROM dn)),
gr AS (SELECT dy.day, day_idx, c.taxonomy_id, coalesce(n, 0) AS n FROM dy CROSS JOIN (SELECT DISTINCT taxonomy_id FROM dn) c LEFT JOIN dn ON dn.day = dy.day AND dn.taxonomy_id = c.taxonomy_id)"""
_WINDOWS = f"""{_GRID}, mx AS (SELECT taxonomy_id, sum(n) / sum(sum(n)) OVER () AS share FROM gr WHERE day_idx <= {BASE} GROUP BY taxonomy_id),
ob AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY taxonomy_id ORDER BY day_idx ROWS {DAYS - 1} PRECEDING) AS observed FROM gr) WHERE day_idx >= {BASE + DAYS}),
ex AS (SELECT *, share * sum(observed) OVER (PARTITION BY day_idx) AS expected FROM ob JOIN mx USING (taxonomy_id)),
ce AS (SELECT day, day_idx, CASE WHEN expected < 5 AND large >= 2 THEN 'other' ELSE taxonomy_id END AS cell, sum(observed) AS o, sum(expected) AS e FROM (SELECT *, sum((expected >= 5)::INT) OVER (PARTITION BY day_idx) AS large FROM ex) GROUP BY ALL),
ch AS (SELECT day, day_idx, sum((o - e) ** 2 / e) AS chi2, count(*) - 1 AS df FROM ce WHERE e > 0 GROUP BY day, day_idx)"""


def _grid(spark, d):
    return drift.daily_grid(keep(classify.mix_per_day(_failures(spark, d)), "daily"))


@query(f"WITH {_GRID} SELECT day, day_idx::INT AS day_idx, taxonomy_id, n FROM gr")
def daily_grid(spark, d):
    return _grid(spark, d)


@query(f"WITH {_WINDOWS} SELECT day, day_idx::INT AS day_idx, taxonomy_id, observed::BIGINT AS observed FROM ob")
def trailing_windows(spark, d):
    return drift.trailing(_grid(spark, d), BASE, DAYS)


@query(f"WITH {_WINDOWS} SELECT day, round(chi2, 6) AS chi2, df FROM ch")
def chi_square_windows(spark, d):
    return drift.chi_square(_grid(spark, d), BASE, DAYS).select("day", F.round("chi2", 6).alias("chi2"), "df")


@query(f"WITH {_WINDOWS}, k AS (SELECT sum(o) AS n, sum(e) AS e FROM ce WHERE day_idx = {BASE + DAYS}) SELECT df::INT AS df, round(exp(-chi2 / 2) * CASE WHEN df = 4 THEN 1 + chi2 / 2 ELSE 1 END, 6) AS p, day FROM ch WHERE df IN (2, 4)")
def chi_square_p(spark, d):
    rows = drift.chi_square(_grid(spark, d), BASE, DAYS).where("df in (2, 4)")
    return rows.select(F.col("df").cast("int").alias("df"), F.round(stats.chi2_sf("chi2", F.col("df").cast("double")), 6).alias("p"), "day")


@query(f"""WITH RECURSIVE {_GRID}, bs AS (SELECT taxonomy_id, avg(n) AS m, stddev_pop(n) AS s FROM gr WHERE day_idx <= {BASE} GROUP BY taxonomy_id HAVING avg(n) > 0 AND stddev_pop(n) > 1e-9),
cu AS (SELECT taxonomy_id, {BASE}::BIGINT AS day_idx, 0.0::DOUBLE AS c, false AS alert FROM bs UNION ALL
  SELECT cu.taxonomy_id, gr.day_idx, greatest(0, (CASE WHEN cu.alert THEN 0 ELSE cu.c END) + (gr.n - m) / s - 0.5), greatest(0, (CASE WHEN cu.alert THEN 0 ELSE cu.c END) + (gr.n - m) / s - 0.5) > {H}
  FROM cu JOIN gr ON gr.taxonomy_id = cu.taxonomy_id AND gr.day_idx = cu.day_idx + 1 JOIN bs ON bs.taxonomy_id = cu.taxonomy_id)
SELECT day_idx::INT AS day_idx, taxonomy_id, round(c, 6) AS cusum, alert FROM cu WHERE day_idx > {BASE}""")
def cusum(spark, d):
    return drift.cusum(_grid(spark, d), BASE, h=H).select("day_idx", "taxonomy_id", F.round("cusum", 6).alias("cusum"), "alert")


@query(f"""WITH RECURSIVE {_WINDOWS}, sg AS (SELECT day_idx, chi2 > 4 AS sig FROM ch),
st AS (SELECT {BASE + DAYS - 1}::BIGINT AS day_idx, false AS sig, false AS alert, CAST([] AS BOOLEAN[]) AS recent UNION ALL
  SELECT day_idx, sig, alert, CASE WHEN alert THEN CAST([] AS BOOLEAN[]) ELSE r END FROM (SELECT sg.day_idx, sg.sig, list_slice(list_append(st.recent, sg.sig), -3, -1) AS r, sg.sig AND len(list_filter(list_slice(list_append(st.recent, sg.sig), -3, -1), lambda x: x)) >= 2 AS alert FROM st JOIN sg ON sg.day_idx = st.day_idx + 1))
SELECT day_idx::INT AS day_idx, sig, alert FROM st WHERE day_idx >= {BASE + DAYS}""")
def two_of_three(spark, d):
    return drift.two_of_three(drift.chi_square(_grid(spark, d), BASE, DAYS).select("day_idx", (F.col("chi2") > 4).alias("sig")))


#: Medians of chi-square by its degrees of freedom.
_MEDIAN = "CASE df WHEN 1 THEN 0.454936 WHEN 2 THEN 1.386294 WHEN 3 THEN 2.365974 WHEN 4 THEN 3.356694 WHEN 5 THEN 4.351460 END"


@query(f"""WITH RECURSIVE {_WINDOWS}, sg AS (SELECT day_idx, chi2 > {_MEDIAN} AS sig FROM ch),
st AS (SELECT {BASE + DAYS - 1}::BIGINT AS day_idx, false AS alert, CAST([] AS BOOLEAN[]) AS recent UNION ALL
  SELECT day_idx, alert, CASE WHEN alert THEN CAST([] AS BOOLEAN[]) ELSE r END FROM (SELECT sg.day_idx, list_slice(list_append(st.recent, sg.sig), -3, -1) AS r, sg.sig AND len(list_filter(list_slice(list_append(st.recent, sg.sig), -3, -1), lambda x: x)) >= 2 AS alert FROM st JOIN sg ON sg.day_idx = st.day_idx + 1)),
bs AS (SELECT taxonomy_id, avg(n) AS m, stddev_pop(n) AS s FROM gr WHERE day_idx <= {BASE} GROUP BY taxonomy_id HAVING avg(n) > 0 AND stddev_pop(n) > 1e-9),
cu AS (SELECT taxonomy_id, {BASE}::BIGINT AS day_idx, 0.0::DOUBLE AS c, false AS alert FROM bs UNION ALL
  SELECT cu.taxonomy_id, gr.day_idx, greatest(0, (CASE WHEN cu.alert THEN 0 ELSE cu.c END) + (gr.n - m) / s - 0.5), greatest(0, (CASE WHEN cu.alert THEN 0 ELSE cu.c END) + (gr.n - m) / s - 0.5) > {H}
  FROM cu JOIN gr ON gr.taxonomy_id = cu.taxonomy_id AND gr.day_idx = cu.day_idx + 1 JOIN bs ON bs.taxonomy_id = cu.taxonomy_id)
SELECT 'chi_square' AS type, ch.day, NULL::VARCHAR AS taxonomy_id, round(chi2, 6) AS statistic FROM ch JOIN st ON st.day_idx = ch.day_idx WHERE st.alert
UNION ALL SELECT 'cusum', d.day, cu.taxonomy_id, round(c, 6) FROM cu JOIN (SELECT DISTINCT day, day_idx FROM gr) d USING (day_idx) WHERE cu.alert""")
def drift_alerts(spark, d):
    """All alerts, at a level at which half of the windows are significant without any drift."""
    found = drift.alerts(classify.mix_per_day(_failures(spark, d)), BASE, DAYS, alpha=0.5, h=H)
    return found.select("type", "day", "taxonomy_id", F.round("statistic", 6).alias("statistic"))


_TERMS = r"tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{2,}')) AS term FROM documents) GROUP BY ALL)"


@query(f"WITH {_TERMS} SELECT term, count(*) AS df, round(ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1, 6) AS idf FROM tf GROUP BY term HAVING count(*) >= 5")
def doc_freq_idf(spark, d):
    docs = table(spark, d, "documents")
    rows = cluster.document_frequency(cluster.term_counts(docs, "doc_id", "text"), docs.count(), 5)
    return rows.select("term", "df", F.round("idf", 6).alias("idf"))


@query(rf"""WITH {_TERMS.replace("documents", "(SELECT item_id AS doc_id, text FROM benchmark)")}, df AS (SELECT term, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN df USING (term)) SELECT doc_id AS item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tfidf_weights(spark, d):
    return cluster.tfidf(table(spark, d, "benchmark"), "item_id", "text").select("item_id", "term", F.round("weight", 6).alias("weight"))


@query("""WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT label, i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM x GROUP BY label, i)
SELECT label, max(n) AS n, round((sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)), 6) AS mean_cosine FROM s GROUP BY label""")
def label_distances(spark, d):
    return cluster.label_distances(table(spark, d, "embeddings")).select("label", "n", F.round("mean_cosine", 6).alias("mean_cosine"))


@query(r"""SELECT page_id, CASE WHEN length(m) > 60 THEN left(m, 59) || '…' ELSE m END AS masked FROM (SELECT page_id, regexp_replace(url, '-?\d+\.\d+|-?\d+', '<n>', 'g') AS m FROM pages)""")
def evidence_mask(spark, d):
    return table(spark, d, "pages").select("page_id", text.clip(text.mask_numbers(F.col("url")), 60).alias("masked"))


@query(f"""WITH {TR}, w AS (SELECT trace_id, taxonomy_id AS before, timeout_stage, tool_error, k1, total_cost, c, unnest(['retrieve.query_rewrite', 'retrieve.top_k']) AS mutation FROM fl WHERE taxonomy_id IS NOT NULL),
m AS (SELECT *, CASE WHEN k1 IS NULL OR k1 = 0 THEN NULL ELSE round(least(0.97, k1 / 100 + 0.18), 3) END AS up FROM w),
n AS (SELECT trace_id, mutation, before, CASE WHEN timeout_stage IS NOT NULL THEN 'F-INFRA-001' WHEN tool_error THEN 'F-TOOL-001' WHEN k1 = 0 THEN 'F-RET-001' WHEN (CASE WHEN mutation = 'retrieve.query_rewrite' THEN up ELSE k1 / 100 END) < 0.5 THEN 'F-RET-002' WHEN total_cost > c THEN 'F-INFRA-002' END AS after FROM m)
SELECT trace_id, mutation, before, after, before IS DISTINCT FROM after AS resolved FROM n""")
def whatif_attempts(spark, d):
    t = keep(event_traces(spark, d), "cohort")
    rows = whatif.attempts(t, classify.cost_limit(t, LIMITS.cost_factor), whatif.DEFAULTS[:2], LIMITS)
    return rows.select("trace_id", "mutation", "before", "after", "resolved")


@query(f"""WITH {TR}, fp AS (SELECT fa.trace_id, failed, CASE taxonomy_id WHEN 'F-INFRA-001' THEN min(pos) FILTER (WHERE status = 'timeout') WHEN 'F-TOOL-001' THEN min(pos) FILTER (WHERE stage = 'tool' AND status = 'error')
  WHEN 'F-INFRA-002' THEN coalesce(min(pos) FILTER (WHERE stage = 'generate'), 0) ELSE min(pos) FILTER (WHERE stage = 'retrieve') END AS p0 FROM fa JOIN ev USING (trace_id) GROUP BY fa.trace_id, failed, taxonomy_id)
SELECT fp.trace_id, CAST(count(*) FILTER (WHERE pos > p0) AS INT) AS downstream, coalesce(string_agg(DISTINCT stage, ',' ORDER BY stage) FILTER (WHERE pos > p0), '') AS stages, round(coalesce(sum(cost) FILTER (WHERE pos > p0), 0), 6) AS cost,
  coalesce(bool_or(stage = 'generate') FILTER (WHERE pos > p0), false) OR any_value(failed) = 'generate' AS user_facing FROM fp JOIN ev USING (trace_id) GROUP BY fp.trace_id""")
def blast_radius(spark, d):
    t = event_traces(spark, d)
    return chain.blast_radius(t, classify.failures(t, LIMITS)).withColumn("cost", F.round("cost", 6))


@query(f"WITH {TR} SELECT trace_id, k1 / 100 AS min_score, k1 / 100 AS mean_score FROM tr WHERE k1 > 0")
def poisoning(spark, d):
    return chain.poisoning(event_traces(spark, d))


@query("SELECT arg_min(event_id, ts) AS event_id, user_id, min(ts) AS ts FROM (SELECT event_id, user_id, ts FROM events UNION ALL SELECT event_id + 1000000, user_id, ts + INTERVAL 1 DAY FROM events) GROUP BY user_id")
def dedupe_first(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    both = e.union(e.select(F.col("event_id") + 1_000_000, "user_id", F.expr("ts + interval 1 day")))
    return both.groupBy("user_id").agg(F.min_by("event_id", "ts").alias("event_id"), F.min("ts").alias("ts"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def upsert_last(spark, d):
    from ..sources.store import upsert

    old = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("new").alias("status"))
    return upsert(old, new, "o_orderkey")


@query(f"WITH {EV}, t AS (SELECT trace_id, min(ts) AS ts, min(day) AS day, count(*)::INT AS n FROM ev GROUP BY trace_id), r AS (SELECT min(day) + 3 AS a, min(day) + 9 AS b FROM t) SELECT trace_id, ts, n FROM t, r WHERE ts BETWEEN a AND b")
def traces_by_time(spark, d):
    t = event_traces(spark, d)
    r = t.agg(F.date_add(F.min("day"), 3).cast("timestamp").alias("a"), F.date_add(F.min("day"), 9).cast("timestamp").alias("b"))
    return t.crossJoin(F.broadcast(r)).where("ts between a and b").select("trace_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.size("spans").alias("n"))


@query(f"WITH {TR}, t AS (SELECT trace_id FROM ev GROUP BY trace_id HAVING max(value) > 200) SELECT count(*) FILTER (WHERE fa.trace_id IS NOT NULL AND t.trace_id IS NOT NULL) AS tp, count(*) FILTER (WHERE t.trace_id IS NULL) AS fp, count(*) FILTER (WHERE fa.trace_id IS NULL) AS fn FROM fa FULL JOIN t ON fa.trace_id = t.trace_id")
def precision_recall(spark, d):
    truth = event_spans(spark, d).groupBy("trace_id").agg(F.max("duration_ms").alias("m")).where("m > 200").select("trace_id", F.lit(1).alias("t"))
    both = _failures(spark, d).select("trace_id", F.lit(1).alias("p")).join(truth, "trace_id", "full")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return both.agg(n(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"), n(F.col("t").isNull()).alias("fp"), n(F.col("p").isNull()).alias("fn"))


@query(f"WITH {EV} SELECT stage, count(*) AS spans, count(DISTINCT trace_id) AS traces, round(sum(cost), 6) AS cost FROM ev GROUP BY stage")
def stage_span_counts(spark, d):
    return event_spans(spark, d).groupBy("stage").agg(F.count("*").alias("spans"), F.countDistinct("trace_id").alias("traces"), F.round(F.sum("cost"), 6).alias("cost"))


@query("SELECT page_id, lower(hex(encode(url))) AS a, lower(hex(encode(url))) AS b, sha256(url) AS digest FROM pages")
def hex_ids(spark, d):
    raw = F.encode("url", "UTF-8")
    plain = F.col("url").rlike("^[0-9a-fA-F]+$")
    b64 = F.base64(raw)
    return table(spark, d, "pages").select("page_id", stages.hex_id(F.hex(raw)).alias("a"), F.when(plain, F.lower(F.hex(raw))).otherwise(stages.hex_id(F.regexp_replace(b64, r"\s", ""))).alias("b"), F.sha2(raw, 256).alias("digest"))


@query("SELECT event_id, date_trunc('second', ts) AS s, date_trunc('millisecond', ts) AS ms FROM events")
def epoch_parse(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    to = lambda x: stages.parse_time(x.cast("string")).cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", to(F.expr("unix_micros(cast(ts as timestamp)) div 1000000")).alias("s"), to(F.floor(micros / 1000)).alias("ms"))


@query("SELECT event_id, json_valid(props || CASE WHEN event_id % 5 = 0 THEN '}' ELSE '' END) AS valid FROM events")
def json_validity(spark, d):
    from ..functions.rules import json_error

    t = F.concat("props", F.when(F.col("event_id") % 5 == 0, "}").otherwise(""))
    return table(spark, d, "events").select("event_id", json_error(t).isNull().alias("valid"))


# The whole of what the SQL of some queries above can follow only in part.


@query()
def whatif_all_attempts(spark, d):
    t = keep(event_traces(spark, d), "cohort")
    rows = whatif.attempts(t, classify.cost_limit(t, LIMITS.cost_factor), limits=LIMITS)
    return rows.select("trace_id", "mutation", "before", "after", "resolved")


@query()
def chi_square_p_all(spark, d):
    rows = drift.chi_square(_grid(spark, d), BASE, DAYS)
    return rows.select("day", F.round("chi2", 6).alias("chi2"), F.col("df").cast("int").alias("df"), F.round(stats.chi2_sf("chi2", F.col("df").cast("double")), 6).alias("p"))


@query(f"WITH {_TERMS} SELECT term, count(*) AS df, round(ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1, 6) AS idf FROM tf GROUP BY term")
def doc_freq_idf_all(spark, d):
    docs = table(spark, d, "documents")
    n = docs.count()
    rows = cluster.document_frequency(cluster.term_counts(docs, "doc_id", "text", n), n)
    return rows.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH {_TERMS}, df AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN df USING (term)) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tfidf_weights_documents(spark, d):
    return cluster.tfidf(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("""WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT label, i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM x GROUP BY label, i),
p AS (SELECT i, sum(s) * sum(s) AS every, sum(s * s) AS own, sum(q) AS q, sum(n) AS n, sum(n * n) AS nn FROM s GROUP BY i)
SELECT round(1 - (sum(own) - sum(q)) / (max(nn) - max(n)), 6) AS intra, round(1 - (sum(every) - sum(own)) / (max(n) * max(n) - max(nn)), 6) AS inter FROM p""")
def label_pair_distances(spark, d):
    return cluster.pair_distances(table(spark, d, "embeddings")).select(F.round("intra", 6).alias("intra"), F.round("inter", 6).alias("inter"))


@query()
def failure_families(spark, d):
    return cluster.cards(cluster.families(_failures(spark, d)))


@query()
def family_cards(spark, d):
    failures = keep(_failures(spark, d), "failures")
    return cluster.family_cards(failures, cluster.families(failures))


@query(f"""WITH {TR}, s AS (SELECT trace_id, arg_min(event_id, pos)::VARCHAR AS asked, (arg_min(event_id, pos) FILTER (WHERE stage = 'retrieve'))::VARCHAR AS retrieval, (arg_min(event_id, pos) FILTER (WHERE stage = 'generate'))::VARCHAR AS generation FROM ev GROUP BY trace_id)
SELECT trace_id, taxonomy_id, asked, retrieval, k1 AS hits, CASE WHEN k1 > 0 THEN k1 / 100 END AS weakest, generation, 'absent' AS guard FROM fa JOIN s USING (trace_id)""")
def causal_chains(spark, d):
    traces = keep(event_traces(spark, d), "cohort")
    rows = incident.cases(traces, classify.failures(traces, LIMITS))
    return rows.select("trace_id", "primary.taxonomy_id", F.col("trigger.span_id").alias("asked"), F.col("poisoning.span_id").alias("retrieval"), F.col("poisoning.hits").cast("long").alias("hits"), "poisoning.weakest", F.col("divergence.span_id").alias("generation"), F.col("guard.state").alias("guard"))


@query()
def incident_pages(spark, d):
    traces = keep(event_traces(spark, d), "cohort")
    return incident.pages(traces, classify.failures(traces, LIMITS))


@query(f"WITH {TR} SELECT taxonomy_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, min(trace_id) AS sample FROM fa GROUP BY taxonomy_id")
def report_classes(spark, d):
    return report.classes(_failures(spark, d)).select("taxonomy_id", "n", F.round("share", 6).alias("share"), F.col("sample.trace_id").alias("sample"))


@query()
def ambiguous_verdicts(spark, d):
    return ambiguous.second_pass(classify.verdicts(keep(event_traces(spark, d), "cohort"), LIMITS), offline=True)


@query(f"""WITH {EV}, st AS (SELECT stage, count(*) AS n, round(quantile_cont(value, 0.5), 2) AS p50_ms, round(quantile_cont(value, 0.95), 2) AS p95_ms, round(avg((status <> 'ok')::INT), 4) AS error_rate FROM ev GROUP BY stage),
fr AS (SELECT arg_min(k, pos) AS k FROM ev WHERE stage = 'retrieve' GROUP BY trace_id),
m AS (SELECT avg((k > 0)::INT) AS hit, avg(k / 100) FILTER (WHERE k > 0) AS mean FROM fr), g AS (SELECT round(avg((k - 50) / 100), 4) AS gain FROM ev WHERE stage = 'rerank')
SELECT stage, n, p50_ms, p95_ms, error_rate, CASE stage WHEN 'retrieve' THEN CASE WHEN hit < 0.7 OR mean < 0.45 THEN 'crit' WHEN hit < 0.9 OR mean < 0.6 THEN 'warn' ELSE 'ok' END WHEN 'rerank' THEN CASE WHEN gain < 0.01 THEN 'warn' ELSE 'ok' END ELSE 'ok' END AS status FROM st, m, g""")
def report_cards(spark, d):
    return health.report_cards(keep(event_traces(spark, d), "cohort")).select("stage", "n", "p50_ms", "p95_ms", "error_rate", "status")


@query("""SELECT lpad(lower(hex(o_custkey)), 32, '0') AS trace_id, count(*)::INT AS n_spans, round(sum(o_totalprice), 4) AS total_cost, arg_min(lpad(lower(hex(o_orderkey)), 16, '0'), (o_orderdate, o_orderkey)) AS first_span,
  min(o_orderdate) AS ts, sum(length(o_orderpriority))::BIGINT AS tokens_in, any_value(c_mktsegment) AS pipeline_name FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey""")
def telemetry_traces(spark, d):
    """An export for each customer, whose spans are the orders: written as JSON, then read by the intake."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    kv = lambda k, kind, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias(kind)).alias("value"))
    nanos = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).cast("string")
    attributes = F.array(*(F.to_json(x) for x in (kv("gen_ai.usage.input_tokens", "intValue", F.length("o_orderpriority").cast("string")), kv("cost", "doubleValue", F.col("o_totalprice")))))
    plain = F.to_json(F.struct(F.lpad(F.hex("o_custkey"), 32, "0").alias("traceId"), F.concat(F.lit("0x"), F.lpad(F.hex("o_orderkey"), 16, "0")).alias("spanId"), F.col("o_orderpriority").alias("name"), nanos.alias("startTimeUnixNano"), F.lit("5000000").alias("durationNanos")))
    span = F.concat(F.expr("left(__span, length(__span) - 1)"), F.lit(', "attributes": ['), F.array_join("__attributes", ","), F.lit("]}"))
    rows = o.withColumn("__span", plain).withColumn("__attributes", attributes).select("o_custkey", "o_orderkey", span.alias("span"))
    spans = rows.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "span"))), lambda x: x["span"]), ",").alias("spans"))
    service = F.to_json(kv("service.name", "stringValue", F.col("c_mktsegment")))
    text = F.concat(F.lit('{"resourceSpans": [{"resource": {"attributes": ['), service, F.lit(']}, "scopeSpans": [{"spans": ['), F.col("spans"), F.lit("]}]}]}"))
    exports = spans.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.lpad(F.col("o_custkey").cast("string"), 20, "0").alias("doc"), text.alias("value"))
    t = otlp.parse(exports)
    tokens = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["tokens_in"])
    return t.select("trace_id", F.size("spans").alias("n_spans"), F.round("total_cost", 4).alias("total_cost"), F.col("spans")[0]["span_id"].alias("first_span"), F.col("ts").cast("timestamp_ntz").alias("ts"), tokens.alias("tokens_in"), "pipeline_name")
