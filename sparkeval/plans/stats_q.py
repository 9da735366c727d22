"""Bootstrap standard errors and corpus text metrics (AGG11, AGG12, AGG20, AGG21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap as BS
from ..operators import textmetrics as TM
from .metrics_q import FX_CLS, FX_QA, rd
from .registry import query, sql

B = BS.DEFAULT_ITERS
TEXT_B = BS.TEXT_METRIC_ITERS


def duck_uniform(*parts: str) -> str:
    label = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({label}), 1, 8)) AS BIGINT) / 4294967296.0"


# log k! as the operator spells it.
_LF = ("CASE " + " ".join(f"WHEN k = {k} THEN {v!r}" for k, v in enumerate(BS.LOG_FACTORIALS))
       + " ELSE (k + 0.5) * ln(greatest(k, 1)) - k + 0.9189385332046727 + 1.0 / (12 * greatest(k, 1)) - 1.0 / (360 * pow(greatest(k, 1), 3)) + 1.0 / (1260 * pow(greatest(k, 1), 5)) END")


def _draws(cells: str, cell: str) -> str:
    """DuckDB twin of cell_draws: CTEs from ``cells`` (task, n, columns ``cell``) to draws (..., b, w)."""
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY {cell}) - 1 AS i, row_number() OVER () AS cell_id FROM ({cells})),
each AS (SELECT cell_id, n, CAST(unnest(range(greatest(0, n - CAST(ceil(9 * sqrt(n)) AS BIGINT) - 40), n + CAST(ceil(9 * sqrt(n)) AS BIGINT) + 41)) AS DOUBLE) AS k FROM numbered),
pmf AS (SELECT cell_id, k, exp(k * ln(n) - n - ({_LF})) AS p FROM each),
cdf AS (SELECT cell_id, k, sum(p) OVER (PARTITION BY cell_id ORDER BY k ROWS UNBOUNDED PRECEDING) / sum(p) OVER (PARTITION BY cell_id) AS c FROM pmf),
cuts AS (SELECT cell_id, k, lag(c, 1, 0.0) OVER w AS low, CASE WHEN lead(c) OVER w IS NULL THEN 2.0 ELSE c END AS high FROM cdf WINDOW w AS (PARTITION BY cell_id ORDER BY k)),
slices AS (SELECT *, unnest(range(CAST(floor(low * 256) AS BIGINT), least(CAST(floor(high * 256) AS BIGINT), 255) + 1)) AS slice FROM cuts WHERE high > low AND low < 1),
drawn AS (SELECT *, CAST(floor(u * 256) AS BIGINT) AS slice FROM (SELECT task, {cell}, cell_id, b, {duck_uniform("1234", "b", "i")} AS u FROM numbered, range(0, {B}) t(b))),
draws AS (SELECT task, {cell}, b, k AS w FROM drawn JOIN slices USING (cell_id, slice) WHERE u >= low AND u < high AND k > 0)"""


@query("bootstrap_stderr", f"""WITH fx AS ({FX_CLS}), {_draws("SELECT task, gold = 1 AS g, pred = 1 AS p, count(*) AS n FROM fx GROUP BY ALL", "g, p")},
m AS (SELECT task, b, sum(CASE WHEN g AND p THEN w ELSE 0 END) AS tp, sum(CASE WHEN NOT g AND p THEN w ELSE 0 END) AS fp,
             sum(CASE WHEN g AND NOT p THEN w ELSE 0 END) AS fn, sum(CASE WHEN NOT g AND NOT p THEN w ELSE 0 END) AS tn FROM draws GROUP BY task, b),
d AS (SELECT *, 2 * tp + fp + fn AS d1, sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS d2 FROM m)
SELECT task, {rd('stddev_samp(CASE WHEN d1 = 0 THEN 0.0 ELSE 2 * tp / d1 END)')} AS stderr_f1,
       {rd('stddev_samp(CASE WHEN d2 = 0 THEN 0.0 ELSE (tp * tn - fp * fn) / d2 END)')} AS stderr_mcc, count(*) AS replicates FROM d GROUP BY task""")
def q_bootstrap_stderr(spark, sf_dir):
    """All replicates of the reference's default, for F1 and MCC."""
    fx = sql(spark, sf_dir, FX_CLS)
    out = BS.bootstrap_stderr(fx, "task", ("f1", "mcc"), B, seed=1234, gold="gold", pred="pred")
    return out.select("task", F.round("stderr_f1", 6).alias("stderr_f1"), F.round("stderr_mcc", 6).alias("stderr_mcc"), "replicates")


# Values with few different cells (mean of three outcomes) and their perplexity.
FX_VALUES = "SELECT source AS task, doc_id, CAST(-1 - doc_id % 3 AS DOUBLE) AS v, n_chars FROM documents"


@query("bootstrap_perplexity", f"""WITH fx AS ({FX_VALUES}), {_draws("SELECT task, v, count(*) AS n FROM fx GROUP BY ALL", "v")},
m AS (SELECT task, b, sum(w * v) / sum(w) AS m FROM draws GROUP BY task, b)
SELECT task, {rd('stddev_samp(m)')} AS stderr_mean, {rd('stddev_samp(exp(-m))')} AS stderr_perplexity, count(*) AS replicates FROM m GROUP BY task""")
def q_bootstrap_perplexity(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_VALUES)
    out = BS.bootstrap_stderr(fx, "task", ("mean", "perplexity"), B, seed=1234, value="v")
    return out.select("task", F.round("stderr_mean", 6).alias("stderr_mean"), F.round("stderr_perplexity", 6).alias("stderr_perplexity"), "replicates")


@query("bootstrap_median", f"""WITH fx AS ({FX_VALUES}), items AS (SELECT task, n_chars AS v, row_number() OVER (PARTITION BY task ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY task) AS n FROM fx),
sizes AS (SELECT DISTINCT task, n FROM items),
d AS (SELECT task, CAST(floor({duck_uniform("1234", "b")} * n) AS BIGINT) AS i FROM sizes, range(0, {B}) t(b))
SELECT task, {rd('stddev_samp(CAST(v AS DOUBLE))')} AS stderr, count(*) AS replicates FROM d JOIN items USING (task, i) GROUP BY task""")
def q_bootstrap_median(spark, sf_dir):
    """The element at position n // 2 of a resample, as the reference's median."""
    out = BS.bootstrap_stderr(sql(spark, sf_dir, FX_VALUES), "task", "median", B, seed=1234, value="n_chars")
    return out.withColumn("stderr", F.round("stderr", 6))


_TOK = "list_filter(string_split_regex({}, '\\s+'), lambda t: t <> '')"


def _grams(src: str, lst: str, n_max: int, sep: str, extra: str = "") -> str:
    return (f"SELECT id, lang{extra}, n, array_to_string({lst}[i:i + n - 1], '{sep}') AS g FROM {src}, range(1, {n_max + 1}) t(n), "
            f"LATERAL (SELECT unnest(generate_series(1, len({lst}) - n + 1)) AS i)")


_BLEU_SQL = f"""WITH fx AS ({FX_QA}),
s AS (SELECT id, lang, {_TOK.format('pred')} AS h, [{_TOK.format('ref1')}, {_TOK.format('ref2')}] AS rs FROM fx),
hc AS (SELECT id, lang, n, g, count(*) AS hc FROM ({_grams('s', 'h', 4, ' ')}) GROUP BY ALL),
sr AS (SELECT id, lang, unnest(rs) AS r, generate_subscripts(rs, 1) AS ri FROM s),
rc AS (SELECT id, lang, n, g, max(c) AS rc FROM (SELECT id, lang, ri, n, g, count(*) AS c
       FROM ({_grams('sr', 'r', 4, ' ', ', ri')}) GROUP BY ALL) GROUP BY id, lang, n, g),
st AS (SELECT lang, n, sum(hc) AS total, sum(least(hc, coalesce(rc, 0))) AS correct FROM hc LEFT JOIN rc USING (id, lang, n, g) GROUP BY ALL),
pv AS (SELECT lang, {', '.join(f"max(CASE WHEN n = {n} THEN total END) AS total{n}, max(CASE WHEN n = {n} THEN correct END) AS correct{n}" for n in range(1, 5))}
       FROM st GROUP BY lang),
ln AS (SELECT lang, CAST(sum(len(h)) AS DOUBLE) AS c,
              CAST(sum(list_min(list_transform(rs, lambda x: {{'d': abs(len(x) - len(h)), 'l': len(x)}})).l) AS DOUBLE) AS r FROM s GROUP BY lang),
j AS (SELECT ln.*, {', '.join(f"CAST(coalesce(total{n}, 0) AS DOUBLE) AS t{n}, CAST(coalesce(correct{n}, 0) AS DOUBLE) AS c{n}" for n in range(1, 5))}
      FROM ln LEFT JOIN pv USING (lang)),
z AS (SELECT *, {', '.join(f"({' + '.join(f'CASE WHEN c{m} = 0 AND t{m} > 0 THEN 1 ELSE 0 END' for m in range(1, n + 1))}) AS z{n}" for n in range(1, 5))} FROM j),
p AS (SELECT *, {', '.join(f"CASE WHEN t{n} = 0 THEN 0.0 WHEN c{n} > 0 THEN 100.0 * c{n} / t{n} ELSE 100.0 / (pow(2.0, z{n}) * t{n}) END AS p{n}" for n in range(1, 5))} FROM z)
SELECT lang, {rd("CASE WHEN p1 <= 0 OR p2 <= 0 OR p3 <= 0 OR p4 <= 0 THEN 0.0 ELSE (CASE WHEN c >= r THEN 1.0 WHEN c > 0 THEN exp(1 - r / c) ELSE 0.0 END) * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) END")} AS bleu,
       c AS sys_len, r AS ref_len FROM p"""


@query("corpus_bleu", _BLEU_SQL)
def q_corpus_bleu(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_QA).withColumn("refs", F.array("ref1", "ref2"))
    return TM.corpus_bleu(fx, "id", "pred", "refs", "lang").withColumn("bleu", F.round("bleu", 6))


_CH = "list_filter(string_split(regexp_replace({}, '\\s', '', 'g'), ''), lambda t: t <> '')"

_CHRF_SQL = f"""WITH fx AS ({FX_QA}),
s AS (SELECT id, lang, {_CH.format('pred')} AS h, {_CH.format('ref1')} AS r FROM fx),
hc AS (SELECT id, lang, n, g, count(*) AS hc FROM ({_grams('s', 'h', 6, '')}) GROUP BY ALL),
rc AS (SELECT id, lang, n, g, count(*) AS rc FROM ({_grams('s', 'r', 6, '')}) GROUP BY ALL),
st AS (SELECT lang, n, sum(hc) AS total, sum(least(hc, coalesce(rc, 0))) AS correct FROM hc LEFT JOIN rc USING (id, lang, n, g) GROUP BY ALL),
rt AS (SELECT lang, n, sum(rc) AS ref_total FROM rc GROUP BY ALL),
j AS (SELECT coalesce(st.lang, rt.lang) AS lang, coalesce(total, 0) AS total, coalesce(correct, 0) AS correct,
             coalesce(ref_total, 0) AS ref_total FROM st FULL JOIN rt USING (lang, n)),
a AS (SELECT lang, sum(CASE WHEN total > 0 THEN correct / total ELSE 1e-16 END) AS sp,
             sum(CASE WHEN ref_total > 0 THEN correct / ref_total ELSE 1e-16 END) AS sr,
             sum(CASE WHEN total > 0 AND ref_total > 0 THEN 1 ELSE 0 END) AS eff FROM j GROUP BY lang)
SELECT lang, {rd("CASE WHEN eff = 0 THEN 0.0 WHEN sp / eff + sr / eff > 0 THEN 100.0 * 5.0 * (sp / eff) * (sr / eff) / (4.0 * (sp / eff) + sr / eff) ELSE 0.0 END")} AS chrf FROM a"""


@query("corpus_chrf", _CHRF_SQL)
def q_corpus_chrf(spark, sf_dir):
    fx = sql(spark, sf_dir, FX_QA)
    return TM.corpus_chrf(fx, "id", "pred", "ref1", "lang").withColumn("chrf", F.round("chrf", 6))


# ------------------------------------------------------------------ bootstrap of the text metrics
_RES = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT) % 2147483647"
_LADDER = " ".join(f"WHEN u < {c!r} THEN {k}" for k, c in enumerate(BS.POISSON1_CDF))


def _weighted(counts: str, names: list[str], score: str) -> str:
    """DuckDB twin of text_bootstrap: ``counts`` (id, lang, names) -> error per language."""
    return f"""r AS (SELECT b, {_RES.format("'1234:' || CAST(b AS VARCHAR)")} AS rb FROM range(0, {TEXT_B}) t(b)),
i AS (SELECT *, {_RES.format("'1234:s:' || CAST(id AS VARCHAR)")} AS ri FROM ({counts})),
x AS (SELECT i.*, b, (ri * rb + ri) % 2147483647 AS x FROM i, r),
u AS (SELECT * EXCLUDE (x), ((((x * x) % 2147483647) * ((x * x) % 2147483647)) % 2147483647 * x) % 2147483647 / 2147483647.0 AS u FROM x),
w AS (SELECT *, CASE {_LADDER} ELSE {len(BS.POISSON1_CDF)} END AS w FROM u),
j AS (SELECT lang, b, {', '.join(f"CAST(sum(w * {n}) AS DOUBLE) AS {n}" for n in names)} FROM w GROUP BY lang, b),
m AS ({score})
SELECT lang, {rd('stddev_samp(m)')} AS stderr, count(*) AS replicates FROM m GROUP BY lang"""


_BLEU_NAMES = ["c", "r"] + [f"{k}{n}" for n in range(1, 5) for k in ("total", "correct")]
_BLEU_COUNTS = f"""SELECT s.id, s.lang, len(h) AS c, list_min(list_transform(rs, lambda x: {{'d': abs(len(x) - len(h)), 'l': len(x)}})).l AS r,
  {', '.join(f"coalesce(total{n}, 0) AS total{n}, coalesce(correct{n}, 0) AS correct{n}" for n in range(1, 5))}
  FROM s LEFT JOIN (SELECT id, {', '.join(f"max(CASE WHEN n = {n} THEN total END) AS total{n}, max(CASE WHEN n = {n} THEN correct END) AS correct{n}" for n in range(1, 5))}
    FROM (SELECT id, n, sum(hc) AS total, sum(least(hc, coalesce(rc, 0))) AS correct FROM hc LEFT JOIN rc USING (id, lang, n, g) GROUP BY ALL) GROUP BY id) USING (id)"""
_BLEU_SCORE = f"""SELECT lang, b, CASE WHEN p1 <= 0 OR p2 <= 0 OR p3 <= 0 OR p4 <= 0 THEN 0.0 ELSE (CASE WHEN c >= r THEN 1.0 WHEN c > 0 THEN exp(1 - r / c) ELSE 0.0 END) * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) END AS m
 FROM (SELECT *, {', '.join(f"CASE WHEN total{n} = 0 THEN 0.0 WHEN correct{n} > 0 THEN 100.0 * correct{n} / total{n} ELSE 100.0 / (pow(2.0, z{n}) * total{n}) END AS p{n}" for n in range(1, 5))}
  FROM (SELECT *, {', '.join(f"({' + '.join(f'CASE WHEN correct{m} = 0 AND total{m} > 0 THEN 1 ELSE 0 END' for m in range(1, n + 1))}) AS z{n}" for n in range(1, 5))} FROM j))"""


@query("bootstrap_bleu", _BLEU_SQL[:_BLEU_SQL.index("st AS (")] + _weighted(_BLEU_COUNTS, _BLEU_NAMES, _BLEU_SCORE))
def q_bootstrap_bleu(spark, sf_dir):
    """Error of corpus BLEU per language, all replicates of the reference."""
    fx = sql(spark, sf_dir, FX_QA).withColumn("refs", F.array("ref1", "ref2"))
    return BS.text_bootstrap(fx, "lang", "bleu", "pred", "refs", "id").withColumn("stderr", F.round("stderr", 6))
