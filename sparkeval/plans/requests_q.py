"""Conversation rendering and request-table queries (PRJ09-PRJ11, JN01, JN04, JN05, WIN04-WIN07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chat as CH
from ..functions.text import words
from ..operators import requests as RQ
from ..operators.scoring import assemble_responses
from .metrics_q import FX_MC, rd
from .registry import load, query, sql, sql_str

_STYLE_NAMES = ["colon_single", "vicuna", "no_colon", "new_line", "chatml", "llama2"]


def _d_piece(st: CH.ChatStyle) -> tuple[str, str]:
    """DuckDB spelling of (head, piece) for a style, over columns system, i, role_idx, text."""
    r0, r1 = sql_str(st.roles[0]), sql_str(st.roles[1])
    role = f"(CASE WHEN role_idx = 0 THEN {r0} ELSE {r1} END)"
    has = "(text IS NOT NULL AND text <> '')"
    pre, _, post = st.system_template.partition("{system_message}")
    sp = f"({sql_str(pre)} || system || {sql_str(post)})"
    sep, sep2 = sql_str(st.sep), sql_str(st.sep2)
    k = st.kind
    if k == "colon_single":
        return f"{sp} || {sep}", f"CASE WHEN {has} THEN {role} || ': ' || text || {sep} ELSE {role} || ':' END"
    if k == "colon_two":
        return (f"{sp} || {sep}",
                f"CASE WHEN {has} THEN {role} || ': ' || text || (CASE WHEN i % 2 = 0 THEN {sep} ELSE {sep2} END) "
                f"ELSE {role} || ':' END")
    if k == "no_colon_single":
        return sp, f"CASE WHEN {has} THEN {role} || text || {sep} ELSE {role} END"
    if k == "new_line":
        return (f"(CASE WHEN {sp} = '' THEN '' ELSE {sp} || {sep} END)",
                f"CASE WHEN {has} THEN {role} || chr(10) || text || {sep} ELSE {role} || chr(10) END")
    if k == "chatml":
        return (f"(CASE WHEN {sp} = '' THEN '' ELSE {sp} || {sep} || chr(10) END)",
                f"CASE WHEN {has} THEN {role} || chr(10) || text || {sep} || chr(10) ELSE {role} || chr(10) END")
    if k == "llama2":
        tag = f"(CASE WHEN i % 2 = 0 THEN {r0} ELSE {r1} END)"
        return (f"(CASE WHEN system <> '' THEN {sp} ELSE '[INST] ' END)",
                f"CASE WHEN {has} THEN (CASE WHEN i = 0 THEN text || ' ' ELSE {tag} || ' ' || text || "
                f"(CASE WHEN i % 2 = 0 THEN {sep} ELSE {sep2} END) END) ELSE {tag} END")
    raise ValueError(k)


_TURNS = """s AS (SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'system' THEN text END, chr(10) ORDER BY turn), '') AS system
      FROM conversations GROUP BY conv_id),
m0 AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS role_idx, text FROM conversations WHERE role <> 'system'),
m1 AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role_idx, text FROM m0)"""

_RENDER_COLS = []
for _n in _STYLE_NAMES:
    _h, _p = _d_piece(CH.STYLES[_n])
    _RENDER_COLS.append(f"{_h} || coalesce(string_agg({_p}, '' ORDER BY i), '') AS prompt_{_n}")

_RENDER_SQL = f"""WITH {_TURNS},
slot AS (SELECT s.conv_id, coalesce((SELECT count(*) FROM m1 WHERE m1.conv_id = s.conv_id), 0) AS i, 1 AS role_idx,
                CAST(NULL AS VARCHAR) AS text FROM s),
m AS (SELECT * FROM m1 UNION ALL SELECT * FROM slot),
j AS (SELECT m.*, s.system FROM m JOIN s USING (conv_id))
SELECT conv_id, {', '.join(_RENDER_COLS)} FROM j GROUP BY conv_id, system"""


@query("render_chat", _RENDER_SQL)
def q_render_chat(spark, sf_dir):
    t = load(spark, sf_dir, "conversations")
    c = CH.conversation_turns(t)
    return c.select("conv_id", *[CH.render_messages(CH.STYLES[n], F.col("system"), F.col("messages")).alias(f"prompt_{n}")
                                 for n in _STYLE_NAMES])


@query("chat_messages", f"""WITH {_TURNS},
it AS (SELECT conv_id, i, CASE WHEN i % 2 = 0 THEN {{'role': 'user', 'content': text}}
                               WHEN text IS NOT NULL THEN {{'role': 'assistant', 'content': text}} END AS item FROM m1),
li AS (SELECT conv_id, list(item ORDER BY i) FILTER (WHERE item IS NOT NULL) AS items FROM it GROUP BY conv_id),
a AS (SELECT s.conv_id, CASE WHEN s.system <> '' THEN [{{'role': 'system', 'content': s.system}}] ELSE [] END
                          || coalesce(li.items, []) AS allm FROM s LEFT JOIN li USING (conv_id))
SELECT conv_id, CAST(to_json(allm) AS VARCHAR) AS messages_json, CAST(len(allm) AS BIGINT) AS n_messages FROM a""")
def q_chat_messages(spark, sf_dir):
    return CH.chat_messages(load(spark, sf_dir, "conversations"))


@query("adapt_text_to_conversation", """SELECT conv_id, turn,
  CASE WHEN ends_with(t, ':') THEN regexp_replace(t, '\\n[^\\n]*$', '') ELSE t END AS adapted
FROM (SELECT conv_id, turn, text || chr(10) || 'Resposta:' AS t FROM conversations)""")
def q_adapt_text(spark, sf_dir):
    t = load(spark, sf_dir, "conversations").select("conv_id", "turn",
                                                     F.concat("text", F.lit("\nResposta:")).alias("t"))
    return t.select("conv_id", "turn", CH.adapt_text_to_conversation("t").alias("adapted"))


# ----------------------------------------------------------------- JN04 / JN05
_REQ = """SELECT conv_id, turn, text, sha256(CAST(to_json(['greedy_until', text]) AS VARCHAR)) AS request_hash
FROM conversations WHERE role = 'user'"""
_CACHE = """SELECT DISTINCT sha256(CAST(to_json(['greedy_until', u.text]) AS VARCHAR)) AS request_hash, a.text AS response
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""


def _requests(spark, sf_dir):
    t = load(spark, sf_dir, "conversations")
    return t.filter(F.col("role") == "user").select("conv_id", "turn", "text",
                                                      RQ.request_hash(F.lit("greedy_until"), "text").alias("request_hash"))


def _cache(spark, sf_dir):
    t = load(spark, sf_dir, "conversations")
    u = t.filter(F.col("role") == "user").alias("u")
    a = t.filter(F.col("role") == "assistant").alias("a")
    j = u.join(a, (F.col("a.conv_id") == F.col("u.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1))
    return j.select(RQ.request_hash(F.lit("greedy_until"), F.col("u.text")).alias("request_hash"),
                    F.col("a.text").alias("response")).distinct()


@query("cache_lookup", f"""WITH r AS ({_REQ}), c AS (SELECT request_hash, min(response) AS response FROM ({_CACHE}) GROUP BY request_hash)
SELECT r.conv_id, r.turn, r.request_hash, true AS hit, c.response FROM r JOIN c USING (request_hash)
UNION ALL SELECT conv_id, turn, request_hash, false, CAST(NULL AS VARCHAR) FROM r
WHERE request_hash NOT IN (SELECT request_hash FROM c)""")
def q_cache_lookup(spark, sf_dir):
    r, c = _requests(spark, sf_dir), _cache(spark, sf_dir)
    hits = RQ.cache_hits(r, c).select("conv_id", "turn", "request_hash", F.lit(True).alias("hit"), "response")
    miss = RQ.cache_misses(r, c).select("conv_id", "turn", "request_hash", F.lit(False).alias("hit"),
                                         F.lit(None).cast("string").alias("response"))
    return hits.unionByName(miss)


@query("dedupe_requests", f"""WITH r AS ({_REQ}) SELECT request_hash, count(*) AS n_copies FROM r GROUP BY request_hash""")
def q_dedupe_requests(spark, sf_dir):
    uniq, _ = RQ.dedupe_requests(_requests(spark, sf_dir))
    return uniq.select("request_hash", "n_copies")


# ----------------------------------------------------------------- WIN04 / WIN05
_ORDER_SQL = "length(text), text, conv_id, turn"


@query("batch_requests", f"""WITH r AS (SELECT conv_id, turn, text, role FROM conversations),
p AS (SELECT *, row_number() OVER (ORDER BY {_ORDER_SQL}) - 1 AS pos FROM r),
f AS (SELECT *, CASE WHEN lag(role) OVER (ORDER BY pos) IS NULL OR lag(role) OVER (ORDER BY pos) <> role THEN 1 ELSE 0 END AS nw FROM p),
g AS (SELECT *, sum(nw) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f),
h AS (SELECT *, min(pos) OVER (PARTITION BY island) AS st FROM g)
SELECT conv_id, turn, pos, CAST(island AS BIGINT) AS island, CAST(floor((pos - st) / 8) AS BIGINT) AS chunk_in_island FROM h""")
def q_batch_requests(spark, sf_dir):
    r = load(spark, sf_dir, "conversations").withColumn("task", F.lit("chat"))
    order = [F.length("text"), F.col("text"), F.col("conv_id"), F.col("turn")]
    out = RQ.batch_requests(r, "task", order, "role", 8)
    return out.select("conv_id", "turn", "pos", "island", F.col("chunk_in_island").cast("bigint"))


@query("length_batches", """SELECT conv_id, turn, role, pos, CAST(floor(pos / 16) AS BIGINT) AS batch FROM (
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY length(text) DESC, text DESC, conv_id DESC, turn DESC) - 1 AS pos
  FROM conversations)""")
def q_length_batches(spark, sf_dir):
    r = load(spark, sf_dir, "conversations")
    d = RQ.length_batches(r, "role", F.length("text"), "text", 16, ties=[F.col("conv_id"), F.col("turn")])
    return d.select("conv_id", "turn", "role", "pos", F.col("batch").cast("bigint").alias("batch"))


# ----------------------------------------------------------------- WIN06 / WIN07
_WIN_SQL = """WITH d AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM documents),
h AS (SELECT doc_id, n, 0 AS w, -1 AS ctx_start, least(64, n) AS ctx_len, 0 AS pred_start, least(64, n) AS pred_len,
             CASE WHEN least(64, n) = 1 THEN 0 ELSE 1 END AS disjoint_ctx_len FROM d WHERE n > 0),
r AS (SELECT doc_id, n, w, 64 + (w - 1) * 49 AS done FROM d, LATERAL (SELECT unnest(range(1, CAST(ceil((n - 64) / 49.0) AS BIGINT) + 1)) AS w) WHERE n > 64),
t AS (SELECT doc_id, n, w, done + least(n - done, 49) - 64 - 1 AS ctx_start, 64 AS ctx_len, done AS pred_start,
             least(n - done, 49) AS pred_len,
             CASE WHEN least(n - done, 49) = 1 THEN 0 ELSE 64 - (least(n - done, 49) - 1) END AS disjoint_ctx_len FROM r),
a AS (SELECT * FROM h UNION ALL SELECT * FROM t)"""


@query("rolling_windows", _WIN_SQL + """
SELECT doc_id, CAST(w AS BIGINT) AS w, CAST(ctx_start AS BIGINT) AS ctx_start, CAST(ctx_len AS BIGINT) AS ctx_len,
       CAST(pred_start AS BIGINT) AS pred_start, CAST(pred_len AS BIGINT) AS pred_len,
       CAST(disjoint_ctx_len AS BIGINT) AS disjoint_ctx_len FROM a""")
def q_rolling_windows(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.size(words("text")).alias("n"))
    return d.select("doc_id", F.explode(RQ.rolling_windows(F.col("n"), 64, 16)).alias("x")).select("doc_id", "x.*")


@query("sum_window_loglik", _WIN_SQL + f"""
SELECT doc_id, {rd('CAST(sum(-0.1 * pred_len - 0.01 * w) AS DOUBLE)')} AS loglik, count(*) AS n_windows FROM a GROUP BY doc_id""")
def q_sum_window_loglik(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.size(words("text")).alias("n"))
    w = d.select("doc_id", F.explode(RQ.rolling_windows(F.col("n"), 64, 16)).alias("x")).select("doc_id", "x.*")
    w = w.withColumn("loglik", -0.1 * F.col("pred_len") - 0.01 * F.col("w"))
    return RQ.sum_window_loglik(w).withColumn("loglik", F.round("loglik", 6))


# ----------------------------------------------------------------- JN01
@query("assemble_responses", f"""WITH r AS (SELECT o_orderpriority AS task, o_orderstatus AS prompt_mode, item_id AS doc_id,
                                  choice_idx AS request_idx, loglik AS resp
                           FROM ({FX_MC}) m JOIN orders o ON o.o_orderkey = m.item_id),
i AS (SELECT o_orderpriority AS task, o_orderstatus AS prompt_mode, o_orderkey AS doc_id FROM orders)
SELECT i.task, i.prompt_mode, i.doc_id, count(*) AS n_resp, arg_min(resp, request_idx) AS first_resp,
       arg_max(resp, request_idx) AS last_resp
FROM i JOIN r USING (task, prompt_mode, doc_id) GROUP BY ALL""")
def q_assemble_responses(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    m = sql(spark, sf_dir, FX_MC)
    r = (m.join(o, o.o_orderkey == m.item_id)
          .select(F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("prompt_mode"),
                  F.col("item_id").alias("doc_id"), F.col("choice_idx").alias("request_idx"), F.col("loglik").alias("resp")))
    items = o.select(F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("prompt_mode"),
                     F.col("o_orderkey").alias("doc_id"))
    a = assemble_responses(items, r)
    return a.select("task", "prompt_mode", "doc_id", F.size("responses").cast("bigint").alias("n_resp"),
                    F.element_at("responses", 1).alias("first_resp"), F.element_at("responses", -1).alias("last_resp"))


# ----------------------------------------------------------------- PRJ09 (runner families)
_FAMILIES = [*CH.FAMILY_TEMPLATES, "generic"]


def _template_sql() -> str:
    whens = " ".join(f"WHEN family = {sql_str(n)} THEN {sql_str(a)} || text || {sql_str(b)}" for n, t in CH.FAMILY_TEMPLATES.items()
                     for a, b in [t.replace("{system}", CH.RUNNER_SYSTEM).split("{prompt}")])
    return f"CASE {whens} ELSE text END"


@query("family_templates", f"""SELECT doc_id, family, {_template_sql()} AS prompt
FROM documents, (SELECT unnest([{', '.join(sql_str(f) for f in _FAMILIES)}]) AS family)""")
def q_family_templates(spark, sf_dir):
    d = load(spark, sf_dir, "documents").withColumn("family", F.explode(F.array(*[F.lit(f) for f in _FAMILIES])))
    return d.select("doc_id", "family", CH.apply_family_template("text", "family").alias("prompt"))
