"""The registered queries of this subpackage and their SQL. Each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, best_fit_packing, conversation_trie, merkle_manifest, minhash_dedup, neighbour_search, personal_data, quality_model, quality_rules, source_mix, suffix_dedup, toxic_spans, warc_legacy
from ._shared import materialise, remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    rows = quality_rules.apply_policy(quality_rules.apply_policy(rows, "base-1", "base_ok"), "web-1", "kept")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(*columns, (~F.col("base_ok")).alias("base_failed"), "kept", "fail_bits")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS x
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')))::BIGINT AS n_upper
      FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM m),
f AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 8 ELSE 0 END
        + CASE WHEN 100 * n_dup_lines > 50 * len(lines) THEN 16 ELSE 0 END
        + CASE WHEN 100 * n_upper > 50 * word_chars THEN 32 ELSE 0 END)::INTEGER AS fail_bits FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""


def op2_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = toxic_spans.learn(docs, labels.where(remainder("doc_id", 3) != 1).select("doc_id", (F.col("toxic") == 1).alias("toxic")))
    rows = toxic_spans.tag(docs, chain)
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialise(source_mix.sizes(table(spark, sf_dir, "documents")), "mix-sizes")
    rules = source_mix.rules(sized, source_mix.targets(sized, weights=(3, 1, 2), share=1.5, limit=2.0))
    return source_mix.mix(sized, rules).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op4_neighbour_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_search.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_model.learn(docs, labels.where((remainder("doc_id", 5) != 0) & (F.col("quality") == 1)))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return quality_model.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=3)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS x
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n
"""


def op8_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_legacy.round_trip(table(spark, sf_dir, "pages"))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM r
"""


def op9_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    learns = F.coalesce(remainder("doc_id", 7) != 2, F.lit(False))
    rows = attention_lm.score(table(spark, sf_dir, "documents"), learns)
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "word_score")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = best_fit_packing.pieces(table(spark, sf_dir, "documents"))
    return best_fit_packing.pack(pieces)


def crc32_sql(text: str) -> str:
    """SQL for the unsigned crc32 of ASCII text."""
    step = "list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {step}))"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(remainder("doc_id", 7) == 0, F.lit(1)).otherwise(0)
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"), claim={"n_chars": F.col("n_chars").cast("decimal(20,0)") + tampered})




OP11_SQL = f"""
WITH RECURSIVE f AS (SELECT doc_id, lang, n_chars::HUGEINT AS n, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN 1 ELSE 0 END AS more,
    concat(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'), coalesce(octet_length(encode(lang)) || ':' || lang, '-')) AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM documents),
g AS (SELECT doc_id, lang, sha256(concat(head, coalesce(length(n::VARCHAR) || ':' || n, '-'), tail)) AS leaf,
    sha256(concat(head, coalesce(length((n + more)::VARCHAR) || ':' || (n + more), '-'), tail)) AS claim FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM g),
low AS (SELECT 0 AS level, lang, i, n, leaf AS h FROM l
    UNION ALL SELECT level + 1, lang, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY level, lang, i // 2, n),
sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS level, i, n, h FROM sub
    UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 2, n),
a AS (SELECT 0 AS level, doc_id, leaf, lang, i, n, claim AS h, '' AS proof FROM l
    UNION ALL SELECT a.level + 1, doc_id, leaf, a.lang, a.i // 2, (a.n + 1) // 2, sha256(CASE WHEN a.i % 2 = 1 THEN s.h || a.h ELSE a.h || coalesce(s.h, '') END), proof || coalesce(s.h, '')
    FROM a LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM a.lang AND s.level = a.level AND s.i = xor(a.i, 1) WHERE a.n > 1),
b AS (SELECT 0 AS level, a.doc_id, a.leaf, sub.h AS subroot, sub.i, sub.n, a.h, a.proof FROM a JOIN sub ON sub.lang IS NOT DISTINCT FROM a.lang WHERE a.n = 1
    UNION ALL SELECT b.level + 1, doc_id, leaf, subroot, b.i // 2, (b.n + 1) // 2, sha256(CASE WHEN b.i % 2 = 1 THEN s.h || b.h ELSE b.h || coalesce(s.h, '') END), proof || coalesce(s.h, '')
    FROM b LEFT JOIN high s ON s.level = b.level AND s.i = xor(b.i, 1) WHERE b.n > 1)
SELECT doc_id, leaf, subroot, high.h AS root, sha256(proof) AS proof_sha256, b.h AS folded_root, b.h = high.h AS verified FROM b JOIN high ON high.n = 1 WHERE b.n = 1
"""


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data.detect(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["kind"].isin(*personal_data.BASE))
    rows = rows.select("doc_id", "found", base.alias("base"))
    counts = (personal_data.counted(F.col("base"), k).alias(f"n_{k}") for k in personal_data.BASE)
    scores = F.array_join(F.transform("found", lambda x: x["score"].cast("string")), ",").alias("scores")
    return rows.select("doc_id", *counts, F.sha2(personal_data.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), personal_data.listed(F.col("found")).alias("spans"), scores)


def _pii_sql() -> str:
    """Every kind on its own, by splitting at its matches; the plain expressions, since DuckDB's engine never goes back."""
    octet = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    digits, plain = "regexp_replace(m, '[^0-9]', '', 'g')", "regexp_replace(m, ' ', '', 'g')"
    card = f"length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {digits}[-1-i]::INT ELSE ({digits}[-1-i]::INT * 2) % 10 + ({digits}[-1-i]::INT * 2) // 10 END)) % 10 = 0"
    alone = "NOT regexp_matches(b, '[A-Za-z0-9]$') AND NOT regexp_matches(a, '^[A-Za-z0-9]')"
    value = "instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', x)::INT - 1"
    mod97 = f"list_reduce(list_concat([0], list_transform(string_split({plain}[5:] || {plain}[:4], ''), lambda x: {value})), lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"
    said = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"), "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", rf"regexp_matches(m, '^{octet}\.{octet}\.{octet}\.{octet}$')"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", card), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
        "iban": (r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", f"{alone} AND length({plain}) BETWEEN 15 AND 34 AND {mod97}"), "card_run": ("[0-9]+", f"{alone} AND {card}"),
        "phone_local": (r"[(0-9](?:[\x20().-]?[0-9()])+", rf"{alone} AND NOT regexp_matches(b, '\+$') AND regexp_matches(m, '^(\([0-9]{{3}}\)\x20?|[0-9]{{3}}[\x20.-])[0-9]{{3}}[\x20.-][0-9]{{4}}$')"),
        "tax_id": ("[0-9](?:-?[0-9])+", f"{alone} AND regexp_matches(m, '^[0-8][0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}$') AND NOT regexp_matches(m, '^(000|666)|-00-|-0000$')"),
    }
    parts = []
    for k, kind in enumerate(personal_data.KINDS):
        pattern, good = said[kind.name]
        near = lambda words: rf"regexp_matches(b || chr(10) || a, '(?i)(^|[^\p{{L}}0-9])({words})([^\p{{L}}0-9]|$)')"
        score = f"least(100, greatest(0, {kind.score} + CASE WHEN {near(kind.up)} THEN {personal_data.UP} ELSE 0 END - CASE WHEN {near(kind.down)} THEN {personal_data.DOWN} ELSE 0 END))"
        parts.append(f"""SELECT doc, {k} AS k, '{kind.name}' AS kind, (e - length(m))::BIGINT AS s, e, {score} AS score FROM (
            SELECT doc, f[i] AS m, right(p[i], {personal_data.NEAR}) AS b, left(p[i + 1], {personal_data.NEAR}) AS a, list_sum(list_transform(f[:i], lambda x: length(x))) + list_sum(list_transform(p[:i], lambda x: length(x))) AS e
            FROM (SELECT doc, f, p, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc, regexp_extract_all(t, '{pattern}') AS f, regexp_split_to_array(t, '{pattern}') AS p FROM d)))
            WHERE {good}{'' if kind.base else f' AND {score} >= {personal_data.REPORT}'}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(parts)}),
u AS (SELECT * FROM s WHERE kind <> 'card_run' OR (doc, s, e) NOT IN (SELECT (doc, s, e) FROM s WHERE kind = 'card')),
w AS (SELECT doc, {', '.join(f"count(*) FILTER (kind = '{b}') AS n_{b}" for b in personal_data.BASE)}, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY k, s) FILTER (k < {len(personal_data.BASE)}) AS base,
    string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY k, s) AS spans, string_agg(score, ',' ORDER BY k, s) AS scores FROM u GROUP BY doc)
SELECT doc_id, {', '.join(f'coalesce(n_{b}, 0)::BIGINT AS n_{b}' for b in personal_data.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN w USING (doc)
"""


OP12_SQL = _pii_sql()


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = conversation_trie.turns(table(spark, sf_dir, "conversations"))
    turns, convs = conversation_trie.rebuilt(said, F.col("conv_id") - F.col("conv_id") % 5, remainder("conv_id", 9))
    return conversation_trie.trie(turns, convs)


OP13_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, text, sha256(concat(octet_length(encode(role)), ':', role, text)) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(octet_length(encode(role)), ':', role, text))) AS p FROM c),
k AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, {crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM o GROUP BY conv_id),
r AS (SELECT k.conv_id, o.p, said, octet_length(encode(text)) AS size FROM k JOIN o ON o.conv_id = k.base AND o.p <= k.h
    UNION ALL SELECT k.conv_id, o.p - k.h + least(k.h, coalesce(b.n, 0)), said, octet_length(encode(text)) FROM k JOIN o ON o.conv_id = k.conv_id AND o.p > k.h LEFT JOIN k b ON b.conv_id = k.base),
x AS (SELECT conv_id, p AS depth, size, sha256(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY p)) AS d FROM r
    UNION ALL SELECT conv_id, 0, 0, '' FROM k),
m AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, d) AS owner, count(*) OVER (PARTITION BY depth, d) AS n_convs, max(depth) OVER (PARTITION BY conv_id) AS len FROM x),
node AS (SELECT owner, depth, n_convs, size FROM m WHERE owner = conv_id),
kid AS (SELECT b.owner, b.depth, a.owner AS up FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth = a.depth + 1 AND b.owner = b.conv_id),
fan AS (SELECT up, depth - 1 AS depth, count(*) AS n FROM kid GROUP BY 1, 2),
val AS (SELECT node.*, coalesce(fan.n, 0) AS kids, (n_convs - 1) * size AS saves FROM node LEFT JOIN fan ON fan.up = owner AND fan.depth = node.depth),
tot AS (SELECT a.owner, a.depth, sum(CASE WHEN v.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum(v.saves) AS saves FROM val v JOIN m a ON a.conv_id = v.owner AND a.depth <= v.depth GROUP BY 1, 2),
fin AS (SELECT owner, depth, string_agg(conv_id, ',' ORDER BY conv_id) AS ids FROM m WHERE depth = len GROUP BY 1, 2)
SELECT v.owner AS conv_id, v.depth, kid.up AS parent_conv_id, v.n_convs::BIGINT AS n_convs, v.kids::BIGINT AS n_children, tot.leaves::BIGINT AS n_leaves, tot.saves::BIGINT AS saved_tokens, sha256(coalesce(fin.ids, '')) AS ends_sha256
FROM val v JOIN tot USING (owner, depth) LEFT JOIN kid USING (owner, depth) LEFT JOIN fin USING (owner, depth)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_quality_rules": op1_quality_rules,
    "op2_toxic_spans": op2_toxic_spans,
    "op3_source_mix": op3_source_mix,
    "op4_neighbour_search": op4_neighbour_search,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality_model": op6_quality_model,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_legacy_archives": op8_legacy_archives,
    "op9_attention_lm": op9_attention_lm,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_personal_data": op12_personal_data,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLE_SQL = {"op1_quality_rules": OP1_SQL, "op7_minhash_dedup": OP7_SQL, "op8_legacy_archives": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op12_personal_data": OP12_SQL, "op13_conversation_trie": OP13_SQL}
