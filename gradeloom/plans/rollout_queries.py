"""Accuracy, advantages, losses and step metrics over order lines and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import sequences as S
from gradeloom.functions import text
from gradeloom.operators import advantages as A
from gradeloom.operators import evaluation as V
from gradeloom.operators import token_stats as T
from gradeloom.plans.base import (
    ROLLOUTS_SQL,
    TOKENS_SQL,
    QuerySet,
    lines,
    rollouts,
    table,
    tokens,
)

QUERIES = QuerySet()


def rounded(df, digits=6):
    """Doubles rounded, so two engines' summation orders agree."""
    return df.select(
        [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


@QUERIES.add(
    "validation_by_source",
    """SELECT d.source AS data_source, round(avg(CAST(l.quality = 1 AS INTEGER)), 6) AS accuracy,
       round(avg(d.n_chars), 6) AS mean_length,
       round(avg(d.n_chars) FILTER (WHERE l.quality = 1), 6) AS mean_length_correct,
       round(avg(d.n_chars) FILTER (WHERE l.quality <> 1), 6) AS mean_length_incorrect
       FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.source""",
)
def validation_by_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    scored = table(spark, sf_dir, "labels").join(d, "doc_id").select(
        F.col("source").alias("data_source"),
        F.col("quality").cast("double").alias("reward"),
        F.col("n_chars").alias("n_tokens"),
    )
    return rounded(V.validation_by_source(scored))


@QUERIES.add(
    "pass_at_k",
    """WITH p AS (SELECT l_orderkey, max(CAST(l_returnflag = 'R' AS INTEGER)) AS best,
         sum(CAST(l_returnflag = 'R' AS INTEGER)) AS total, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT round(sum(total) / sum(n), 6) AS pass_at_1, round(avg(CAST(best = 1 AS INTEGER)), 6) AS pass_at_n,
         min(n) AS samples_min, max(n) AS samples_max, count(*) AS prompts FROM p""",
)
def pass_at_k(spark, sf_dir):
    scored = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("uid"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("reward"),
    )
    return rounded(V.pass_at_k(scored))


@QUERIES.add(
    "prompt_accuracy",
    """SELECT l_orderkey AS uid, round(avg(CAST(l_quantity >= 45 AS INTEGER)), 6) AS accuracy
       FROM lineitem GROUP BY 1""",
)
def prompt_accuracy(spark, sf_dir):
    scored = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("uid"), F.when(F.col("l_quantity") >= 45, 1.0).otherwise(0.0).alias("reward")
    )
    return rounded(A.prompt_accuracy(scored))


_GRPO_SQL = """, g AS (SELECT uid, avg(reward) AS m, coalesce(stddev_samp(reward), 0) AS s FROM rollouts GROUP BY uid)
   SELECT r.uid, r.sample, round({value}, 6) AS advantage FROM rollouts r JOIN g ON g.uid = r.uid"""


@QUERIES.add(
    "grpo_advantage",
    f"WITH {ROLLOUTS_SQL}" + _GRPO_SQL.format(value="(r.reward - g.m) / (g.s + 1e-6)"),
)
def grpo_advantage(spark, sf_dir):
    return rounded(A.grpo_advantage(rollouts(spark, sf_dir)).select("uid", "sample", "advantage"))


@QUERIES.add(
    "grpo_advantage_mask_truncated",
    f"WITH {ROLLOUTS_SQL}" + _GRPO_SQL.format(
        value="CASE WHEN r.reward = 0 AND r.n_tokens = 40 THEN 0.0 ELSE (r.reward - g.m) / (g.s + 1e-6) END"
    ),
)
def grpo_advantage_mask_truncated(spark, sf_dir):
    out = A.grpo_advantage(rollouts(spark, sf_dir), max_length=40)
    return rounded(out.select("uid", "sample", "advantage"))


@QUERIES.add(
    "spread_to_tokens",
    f"""WITH {TOKENS_SQL} SELECT t.seq_id, t.pos, round(o.o_totalprice * t.mask, 2) AS advantage
        FROM tokens t JOIN orders o ON o.o_orderkey = t.seq_id""",
)
def spread_to_tokens(spark, sf_dir):
    values = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq_id"), F.col("o_totalprice").alias("advantage")
    )
    toks = tokens(spark, sf_dir).select("seq_id", "pos", "mask")
    out = A.spread_to_tokens(toks, values, "seq_id", "advantage")
    return rounded(out.select("seq_id", "pos", "advantage"), 2)


@QUERIES.add(
    "gae_advantage",
    f"""WITH RECURSIVE {TOKENS_SQL}, ends AS (SELECT seq_id, max(pos) AS last FROM tokens GROUP BY 1),
        a(seq_id, pos, value, adv) AS (
          SELECT t.seq_id, t.pos, t.value, t.reward - t.value FROM tokens t JOIN ends e ON e.seq_id = t.seq_id AND e.last = t.pos
          UNION ALL
          SELECT t.seq_id, t.pos, t.value, t.reward + 0.9137 * a.value - t.value + 0.9137 * 0.9431 * a.adv
          FROM a JOIN tokens t ON t.seq_id = a.seq_id AND t.pos = a.pos - 1)
        SELECT seq_id, pos, round(adv, 6) AS advantage, round(adv + value, 6) AS returns FROM a""",
)
def gae_advantage(spark, sf_dir):
    toks = tokens(spark, sf_dir).select("seq_id", "pos", "reward", "value")
    out = A.gae_advantage(toks, 0.9137, 0.9431)
    return rounded(out.withColumn("pos", F.col("pos").cast("bigint")))


@QUERIES.add(
    "masked_whiten",
    """WITH m AS (SELECT avg(l_tax) AS a, var_samp(l_tax) AS v FROM lineitem WHERE l_linestatus = 'O')
       SELECT l_orderkey, l_partkey, l_suppkey, round((l_tax - a) / sqrt(v + 1e-8), 6) AS whitened,
         round((l_tax - a) / sqrt(v + 1e-8) + a, 6) AS kept_mean FROM lineitem, m""",
)
def masked_whiten(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey",
        F.col("l_tax").alias("whitened"), F.col("l_tax").alias("kept_mean"),
        (F.col("l_linestatus") == "O").cast("int").alias("mask"),
    )
    out = A.masked_whiten(A.masked_whiten(rows, "whitened"), "kept_mean", shift_mean=False)
    return rounded(out.drop("mask"))


@QUERIES.add(
    "masked_stats",
    """SELECT round(sum(l_tax) FILTER (WHERE l_linestatus = 'O'), 4) AS masked_sum,
       round(avg(l_tax) FILTER (WHERE l_linestatus = 'O'), 4) AS masked_mean,
       round(var_pop(l_tax) FILTER (WHERE l_linestatus = 'O'), 4) AS masked_var,
       round(var_samp(l_tax) FILTER (WHERE l_linestatus = 'O'), 4) AS masked_var_unbiased FROM lineitem""",
)
def masked_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_tax", (F.col("l_linestatus") == "O").cast("int").alias("mask")
    )
    return rounded(T.masked_stats(rows, "l_tax"), 4)


@QUERIES.add(
    "sequence_lengths",
    """SELECT l_orderkey AS seq_id,
       CAST(sum(CASE WHEN l_linenumber <= 2 AND l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS prompt_length,
       CAST(sum(CASE WHEN l_linenumber > 2 AND l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS response_length
       FROM lineitem GROUP BY 1""",
)
def sequence_lengths(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("seq_id"), "l_linenumber",
        (F.col("l_linestatus") == "O").cast("int").alias("mask"),
    )
    return T.sequence_lengths(rows, F.col("l_linenumber") <= 2)


def _metric_sql(parts):
    return " UNION ALL ".join(
        f"SELECT '{name}' AS name, round({value}, 6)::DOUBLE AS value FROM {source}"
        for name, value, source in parts
    )


def _spread_sql(name, column, source):
    return [(f"{name}_{f}", f"{g}({column})", source) for f, g in (("mean", "avg"), ("max", "max"), ("min", "min"))]


@QUERIES.add(
    "batch_metrics",
    f"""WITH base AS (SELECT l_orderkey AS seq_id, CAST(l_linestatus = 'O' AS INTEGER) AS mask, l_tax AS value,
          CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS score, l_discount AS reward,
          (l_quantity - 25) / 25 AS advantage, l_quantity / 50 AS returns, l_linenumber FROM lineitem),
        kept AS (SELECT * FROM base WHERE mask = 1),
        seqs AS (SELECT seq_id, sum(score) AS score, sum(reward) AS reward, sum(mask) AS len,
          sum(l_linenumber) AS plen FROM base GROUP BY 1)
        """ + _metric_sql(
        _spread_sql("advantages", "advantage", "kept") + _spread_sql("returns", "returns", "kept")
        + _spread_sql("values", "value", "kept")
        + [("vf_explained_var", "1 - var_samp(returns - value) / (var_samp(returns) + 1e-5)", "kept")]
        + _spread_sql("score", "score", "seqs") + _spread_sql("rewards", "reward", "seqs")
        + _spread_sql("response_length", "len", "seqs") + _spread_sql("prompt_length", "plen", "seqs")
        + [("response_length_clip_ratio", "avg(CAST(len = 5 AS INTEGER))", "seqs"),
           ("prompt_length_clip_ratio", "avg(CAST(plen = 10 AS INTEGER))", "seqs")]
    ),
)
def batch_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    toks = li.select(
        F.col("l_orderkey").alias("seq_id"),
        (F.col("l_linestatus") == "O").cast("int").alias("mask"),
        F.col("l_tax").alias("value"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("score"),
        F.col("l_discount").alias("reward"),
        ((F.col("l_quantity") - 25) / 25).alias("advantage"),
        (F.col("l_quantity") / 50).alias("returns"),
    )
    prompts = li.groupBy(F.col("l_orderkey").alias("seq_id")).agg(
        F.sum("l_linenumber").alias("prompt_length")
    )
    return rounded(T.batch_metrics(toks, 5, prompts, 10))


_SECTIONS = {"click": "gen", "view": "adv", "purchase": "ref", "error": "testing", "signup": "update_actor"}


@QUERIES.add(
    "timing_metrics",
    """WITH s AS (SELECT CAST(day(ts) AS INTEGER) AS step,
         CASE event_type WHEN 'click' THEN 'gen' WHEN 'view' THEN 'adv' WHEN 'purchase' THEN 'ref'
           WHEN 'error' THEN 'testing' ELSE 'update_actor' END AS section, sum(value) AS seconds FROM events GROUP BY 1, 2),
       t AS (SELECT CAST(day(l_shipdate) AS INTEGER) AS step, sum(l_quantity) AS r, sum(l_linenumber) AS p FROM lineitem GROUP BY 1)
       SELECT s.step, section, round(seconds, 4) AS timing_s,
         round(CASE WHEN section = 'gen' THEN seconds * 1000 / r WHEN section <> 'testing' THEN seconds * 1000 / (r + p) END, 4)
           AS timing_per_token_ms FROM s LEFT JOIN t ON t.step = s.step""",
)
def timing_metrics(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for kv in _SECTIONS.items() for x in kv])
    sections = (
        table(spark, sf_dir, "events")
        .groupBy(F.dayofmonth("ts").alias("step"), names[F.col("event_type")].alias("section"))
        .agg(F.sum("value").alias("seconds"))
    )
    totals = table(spark, sf_dir, "lineitem").groupBy(F.dayofmonth("l_shipdate").alias("step")).agg(
        F.sum("l_quantity").alias("response_tokens"), F.sum("l_linenumber").alias("prompt_tokens")
    )
    return rounded(T.timing_metrics(sections, totals), 4)


@QUERIES.add(
    "reduce_metrics",
    """SELECT CAST(ts AS DATE)::VARCHAR AS step, event_type AS name, round(avg(value), 6) AS value
       FROM events GROUP BY 1, 2""",
)
def reduce_metrics(spark, sf_dir):
    metrics = table(spark, sf_dir, "events").select(
        F.to_date("ts").cast("string").alias("step"), F.col("event_type").alias("name"), "value"
    )
    return rounded(T.reduce_metrics(metrics))


@QUERIES.add(
    "eos_mask",
    f"""WITH {TOKENS_SQL} SELECT seq_id, pos, CASE WHEN coalesce(sum(CAST(token_id % 10 = 0 AS INTEGER)) OVER
          (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0
          THEN 1 ELSE 0 END AS eos_mask FROM tokens""",
)
def eos_mask(spark, sf_dir):
    toks = tokens(spark, sf_dir).select("seq_id", "pos", (F.col("token_id") % 10).alias("token_id"))
    return T.eos_mask(toks, 0).drop("token_id")


@QUERIES.add(
    "position_ids",
    f"""WITH {TOKENS_SQL} SELECT seq_id, pos, CAST(greatest(sum(mask) OVER
          (PARTITION BY seq_id ORDER BY pos) - 1, 0) AS BIGINT) AS position_id FROM tokens""",
)
def position_ids(spark, sf_dir):
    return T.position_ids(tokens(spark, sf_dir).select("seq_id", "pos", "mask")).drop("mask")


@QUERIES.add(
    "cumulative_tokens",
    """WITH s AS (SELECT CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS INTEGER) AS step,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens FROM lineitem GROUP BY 1)
       SELECT step, tokens, CAST(sum(tokens) OVER (ORDER BY step) AS BIGINT) AS total_tokens FROM s""",
)
def cumulative_tokens(spark, sf_dir):
    steps = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.date_format("l_shipdate", "yyyyMMdd").cast("int").alias("step"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("tokens"))
    )
    return T.cumulative_tokens(steps)


@QUERIES.add(
    "adaptive_kl_series",
    """WITH s AS (SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS step, avg(l_tax) AS kl, count(*) AS n
         FROM lineitem GROUP BY 1),
       f AS (SELECT step, 1 + greatest(least(kl / 0.04 - 1, 0.2), -0.2) * n / 1000 AS m FROM s)
       SELECT step, round(0.2 * coalesce(product(m) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1), 6) AS kl_coef FROM f""",
)
def adaptive_kl_series(spark, sf_dir):
    steps = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.date_format("l_shipdate", "yyyyMM").cast("int").alias("step"))
        .agg(F.avg("l_tax").alias("kl"), F.count(F.lit(1)).alias("n"))
    )
    return rounded(T.adaptive_kl_series(steps, 0.2, 0.04, 1000.0).select("step", "kl_coef"))


_KL_SQL = """, k AS (SELECT seq_id, pos, mask, reward, (old_logp - ref_logp) * mask AS kl FROM tokens)"""


@QUERIES.add(
    "kl_reward",
    f"WITH {TOKENS_SQL} {_KL_SQL} SELECT seq_id, pos, round(kl + 0.0, 6) AS kl, round(reward - 0.1 * kl, 6) AS reward FROM k",
)
def kl_reward(spark, sf_dir):
    out = T.kl_reward(tokens(spark, sf_dir), 0.1)
    return rounded(out.select("seq_id", "pos", (F.col("kl") + 0.0).alias("kl"), "reward"))


@QUERIES.add(
    "mean_sequence_kl",
    f"""WITH {TOKENS_SQL} {_KL_SQL}, e AS (SELECT seq_id, sum(kl) / nullif(sum(mask), 0) AS kl FROM k GROUP BY 1)
        SELECT round(avg(kl), 6) AS kl, count(kl) AS sequences FROM e""",
)
def mean_sequence_kl(spark, sf_dir):
    return rounded(T.mean_sequence_kl(T.kl_reward(_raw_tokens(spark, sf_dir), 0.1)))


def _raw_tokens(spark, sf_dir):
    """The token columns without a position, for metrics that need none."""
    zero = F.lit(0.0)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("seq_id"),
        (F.col("l_linestatus") == "O").cast("int").alias("mask"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("reward"),
        F.col("l_tax").alias("value"),
        (F.col("l_tax") + F.col("l_discount")).alias("vpred"),
        (F.col("l_quantity") / 50.0).alias("returns"),
        (zero - F.col("l_discount")).alias("old_logp"),
        (zero - F.col("l_discount") * 1.5).alias("logp"),
        (zero - F.col("l_tax")).alias("ref_logp"),
        (F.col("l_quantity") / 50.0).alias("entropy"),
        ((F.col("l_quantity") - 25.0) / 25.0).alias("advantage"),
    )


_POLICY_SQL = f"""WITH {TOKENS_SQL}, r AS (SELECT seq_id, mask, logp - old_logp AS d, exp(logp - old_logp) AS ratio, advantage AS a FROM tokens),
  l AS (SELECT seq_id, mask, d, -a * ratio AS free, -a * greatest(least(ratio, 1 + @high), 1 - @low) AS clipped FROM r),
  s AS (SELECT seq_id, sum(greatest(free, clipped) * mask) AS loss, sum(CAST(clipped > free AS INTEGER) * mask) AS c,
    sum(-d * mask) AS kl, sum(mask) AS n FROM l GROUP BY 1)
  SELECT round(@loss, 6) AS pg_loss, round(sum(c) / sum(n), 6) AS pg_clipfrac, round(sum(kl) / sum(n), 6) AS ppo_kl FROM s"""


@QUERIES.add(
    "policy_loss_stats",
    _POLICY_SQL.replace("@high", "0.02").replace("@low", "0.02").replace("@loss", "sum(loss) / sum(n)"),
)
def policy_loss_stats(spark, sf_dir):
    return rounded(T.policy_loss_stats(_raw_tokens(spark, sf_dir), 0.02))


@QUERIES.add(
    "policy_loss_by_sequence",
    _POLICY_SQL.replace("@high", "0.03").replace("@low", "0.01").replace("@loss", "avg(loss / greatest(n, 1))"),
)
def policy_loss_by_sequence(spark, sf_dir):
    raw = _raw_tokens(spark, sf_dir)
    return rounded(T.policy_loss_stats(raw, 0.2, 0.01, 0.03, token_level=False))


@QUERIES.add(
    "value_loss_stats",
    """WITH v AS (SELECT l_tax AS old, l_tax + l_discount AS p, l_quantity / 50.0 AS r FROM lineitem WHERE l_linestatus = 'O'),
       e AS (SELECT (p - r) ** 2 AS free, (greatest(least(p, old + 0.05), old - 0.05) - r) ** 2 AS clipped FROM v)
       SELECT round(0.5 * avg(greatest(free, clipped)), 6) AS vf_loss, round(avg(CAST(clipped > free AS INTEGER)), 6) AS vf_clipfrac FROM e""",
)
def value_loss_stats(spark, sf_dir):
    return rounded(T.value_loss_stats(_raw_tokens(spark, sf_dir), 0.05))


@QUERIES.add(
    "kl_entropy_stats",
    f"""WITH {TOKENS_SQL}, m AS (SELECT avg(entropy) AS e,
          avg(greatest(least(exp(ref_logp - logp) - (ref_logp - logp) - 1, 10), -10)) AS k FROM tokens WHERE mask = 1)
        SELECT round(e, 6) AS entropy, round(k, 6) AS kl, round(0.5 - 0.001 * e + 0.04 * k, 6) AS total_loss FROM m""",
)
def kl_entropy_stats(spark, sf_dir):
    return rounded(T.kl_entropy_stats(_raw_tokens(spark, sf_dir), F.lit(0.5), 0.001, 0.04))


@QUERIES.add(
    "kl_penalty",
    """SELECT l_orderkey, l_partkey, l_suppkey, round(d + 0.0, 6) AS kl, round(abs(d), 6) AS kl_abs, round(0.5 * d * d, 6) AS kl_mse,
       round(greatest(least(exp(-d) + d - 1, 10), -10), 6) AS kl_low_var, round(1 - 0.5 * d, 6) AS penalized FROM
       (SELECT *, (l_tax - l_discount) * 30 AS d FROM lineitem)""",
)
def kl_penalty(spark, sf_dir):
    p, q = F.col("l_tax") * 30, F.col("l_discount") * 30
    kinds = {"kl": "kl", "kl_abs": "abs", "kl_mse": "mse", "kl_low_var": "low_var_kl"}
    out = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey",
        *[S.kl_penalty(p, q, k).alias(n) for n, k in kinds.items()],
        S.penalized_reward(F.lit(1.0), p, q, 0.5).alias("penalized"),
    )
    return rounded(out)


@QUERIES.add(
    "clip_by_value",
    "SELECT event_id, greatest(least(value, user_id + 5.0), CAST(user_id AS DOUBLE)) AS clipped FROM events",
)
def clip_by_value(spark, sf_dir):
    low = F.col("user_id").cast("double")
    return table(spark, sf_dir, "events").select(
        "event_id", S.clip(F.col("value"), low, low + 5.0).alias("clipped")
    )


@QUERIES.add(
    "binary_entropy",
    """SELECT l_orderkey, round(CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE 0.0 - (p * log2(p) + (1 - p) * log2(1 - p)) END, 6) AS entropy,
       round(p * (1 - p), 6) AS variance FROM
       (SELECT l_orderkey, avg(CAST(l_quantity >= 45 AS INTEGER)) AS p FROM lineitem GROUP BY 1)""",
)
def binary_entropy(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.avg((F.col("l_quantity") >= 45).cast("int")).alias("p")
    )
    out = p.select(
        "l_orderkey", S.binary_entropy(F.col("p")).alias("entropy"),
        S.bernoulli_variance(F.col("p")).alias("variance"),
    )
    return rounded(out)


@QUERIES.add(
    "masked_token_loss",
    """SELECT round(avg(l_quantity / 50.0) FILTER (WHERE l_linestatus = 'O'), 6) AS loss FROM lineitem""",
)
def masked_token_loss(spark, sf_dir):
    return rounded(T.masked_token_loss(_raw_tokens(spark, sf_dir), "entropy"))


@QUERIES.add(
    "step_totals",
    """WITH r AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS step, avg(o_totalprice) AS mean_reward FROM orders GROUP BY 1),
       t AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS step, sum(l_quantity) AS response_tokens FROM lineitem GROUP BY 1)
       SELECT step, round(mean_reward, 4) AS mean_reward, response_tokens FROM r FULL JOIN t USING (step)""",
)
def step_totals(spark, sf_dir):
    roots = table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("step"), F.col("o_totalprice").alias("reward")
    )
    responses = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("step"), F.col("l_quantity").alias("n_tokens")
    )
    return rounded(T.step_totals(roots, responses), 4)


_SHAPE = T.ModelShape(hidden=1536, layers=28, heads=12, kv_heads=2, intermediate=8960, vocab=151936)


@QUERIES.add(
    "flops_by_step",
    f"""SELECT CAST(year(l_shipdate) AS INTEGER) AS step, round((6.0 * {_SHAPE.dense_parameters} * sum(l_quantity)
          + 12.0 * {_SHAPE.attention_width} * sum(l_quantity * l_quantity)) / 20.0 / 1e12, 6) AS tflops
        FROM lineitem GROUP BY 1""",
)
def flops_by_step(spark, sf_dir):
    seqs = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("step"), F.col("l_quantity").alias("n_tokens"), F.lit(20.0).alias("seconds")
    )
    return rounded(T.flops_by_step(seqs, _SHAPE))


@QUERIES.add("best_metric", "SELECT max(value) AS best, max(value) > 0.2 AS passed FROM events")
def best_metric(spark, sf_dir):
    line = text.format_log_line(F.dayofmonth("ts"), {"critic/rewards/mean": F.col("value")})
    parsed = table(spark, sf_dir, "events").select(text.parse_log_line(line).alias("metrics"))
    return T.best_metric(parsed, "critic/rewards/mean", 0.2)


# --- token arrays: one sequence per document, word lengths as token ids -------

_IDS_SQL = "list_transform(string_split(text, ' '), lambda w: length(w))"


def _ids(spark, sf_dir):
    words = F.transform(F.split("text", " "), lambda w: F.length(w))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("ids"))


def _joined(column):
    return F.md5(F.array_join(column.cast("array<string>"), ","))


@QUERIES.add(
    "pad_truncate",
    f"""WITH d AS (SELECT doc_id, {_IDS_SQL} AS ids FROM documents),
        p AS (SELECT doc_id, ids, list_transform(range(greatest(200 - len(ids), 0)), lambda i: 0) AS pad FROM d)
        SELECT doc_id,
          md5(array_to_string(CASE WHEN len(ids) > 200 THEN ids[len(ids) - 199:] ELSE pad || ids END, ',')) AS left_left,
          md5(array_to_string(CASE WHEN len(ids) > 200 THEN ids[:200] ELSE ids || pad END, ',')) AS right_right,
          md5(array_to_string(list_transform(range(200), lambda i: CASE WHEN i >= len(pad) THEN 1 ELSE 0 END), ',')) AS mask
        FROM p""",
)
def pad_truncate(spark, sf_dir):
    ids = F.col("ids")
    return _ids(spark, sf_dir).select(
        "doc_id",
        _joined(S.pad_truncate(ids, 200, 0, "left", "left")).alias("left_left"),
        _joined(S.pad_truncate(ids, 200, 0, "right", "right")).alias("right_right"),
        _joined(S.attention_mask(ids, 200, "left")).alias("mask"),
    )


@QUERIES.add(
    "strip_padding",
    f"SELECT doc_id, md5(array_to_string({_IDS_SQL}, ',')) AS ids FROM documents",
)
def strip_padding(spark, sf_dir):
    width = F.size("ids") + 7
    padded = F.concat(F.array_repeat(F.lit(0), 7), F.col("ids"))
    mask = F.transform(F.sequence(F.lit(1), width), lambda i: (i > 7).cast("int"))
    return _ids(spark, sf_dir).select("doc_id", _joined(S.strip_padding(padded, mask)).alias("ids"))


@QUERIES.add(
    "loss_mask",
    f"""WITH d AS (SELECT doc_id, len({_IDS_SQL}) AS n FROM documents)
        SELECT doc_id, md5(array_to_string(list_transform(range(200), lambda i: CASE
          WHEN i >= least(n, 200) OR i < CASE WHEN n // 3 > 1 THEN least(n // 3, 200) - 1 ELSE 0 END
            OR i = least(n, 200) - 1 THEN 0 ELSE 1 END), ',')) AS mask FROM d""",
)
def loss_mask(spark, sf_dir):
    n = F.size("ids")
    prompt = F.floor(n / 3).cast("int")
    mask = S.loss_mask(S.attention_mask(F.col("ids"), 200, "right"), prompt, n - prompt)
    return _ids(spark, sf_dir).select("doc_id", _joined(mask).alias("mask"))


@QUERIES.add(
    "array_eos_mask",
    f"""WITH d AS (SELECT doc_id, {_IDS_SQL} AS ids FROM documents)
        SELECT doc_id, CASE WHEN list_contains(ids, 11) THEN list_position(ids, 11) ELSE len(ids) END AS kept FROM d""",
)
def array_eos_mask(spark, sf_dir):
    mask = S.eos_mask(F.col("ids"), 11)
    kept = F.aggregate(mask, F.lit(0), lambda a, m: a + m)
    return _ids(spark, sf_dir).select("doc_id", kept.cast("bigint").alias("kept"))


@QUERIES.add(
    "array_position_ids",
    f"""WITH d AS (SELECT doc_id, len({_IDS_SQL}) AS n FROM documents)
        SELECT doc_id, md5(array_to_string(list_transform(range(200),
          lambda i: greatest(i - (200 - least(n, 200)), 0)), ',')) AS ids FROM d""",
)
def array_position_ids(spark, sf_dir):
    mask = S.attention_mask(F.col("ids"), 200, "left")
    return _ids(spark, sf_dir).select("doc_id", _joined(S.position_ids(mask)).alias("ids"))


@QUERIES.add(
    "place_reward",
    f"""WITH d AS (SELECT doc_id, n_chars, len({_IDS_SQL}) AS n FROM documents)
        SELECT doc_id, n AS place, CAST(n_chars AS DOUBLE) AS total, n + 3 AS width FROM d""",
)
def place_reward(spark, sf_dir):
    n = F.size("ids")
    placed = S.place_reward(n + 3, n, F.col("n_chars").cast("double"))
    d = _ids(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return d.select("doc_id", placed.alias("r")).select(
        "doc_id",
        F.array_position("r", F.array_max("r")).alias("place"),
        F.aggregate("r", F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.size("r").cast("bigint").alias("width"),
    )
