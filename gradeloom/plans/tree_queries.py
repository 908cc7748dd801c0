"""Reward trees: customer (root), its orders, their lines (leaves)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import advantages as A
from gradeloom.operators import statistics as X
from gradeloom.operators import trees as T
from gradeloom.operators.skew import with_group_index
from gradeloom.plans.base import LINES_SQL, QuerySet, lines, table
from gradeloom.plans.rollout_queries import rounded
from gradeloom.session import stored

QUERIES = QuerySet()

DEPTH = 2

NODES_SQL = LINES_SQL + """,
  kept AS (SELECT l.*, o.o_custkey, o.o_totalprice, o.o_orderpriority, o.o_orderdate
           FROM lines l JOIN orders o ON o.o_orderkey = l.l_orderkey),
  ord AS (SELECT DISTINCT l_orderkey, o_custkey, o_totalprice, o_orderpriority FROM kept),
  nodes AS MATERIALIZED (
    SELECT DISTINCT o_custkey AS tree_id, 'c' || o_custkey AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 0 AS depth,
      0.0::DOUBLE AS reward, CAST(NULL AS DOUBLE) AS log_prob, [o_custkey] AS path FROM ord
    UNION ALL SELECT o_custkey, 'o' || l_orderkey, 'c' || o_custkey, 1, 0.0, 0.0 - o_totalprice / 100000.0,
      [o_custkey, l_orderkey] FROM ord
    UNION ALL SELECT o_custkey, 'l' || l_orderkey || '-' || pos, 'o' || l_orderkey, 2,
      CASE WHEN l_quantity >= 45 THEN 1.0 ELSE 0.0 END, 0.0 - l_extendedprice / 100000.0, [o_custkey, l_orderkey, pos] FROM kept)"""


def propagate_sql(source: str, prefix: str) -> str:
    """Three levels, leaves first."""
    return f"""{prefix}2 AS (SELECT * FROM {source} WHERE depth = 2),
  {prefix}m1 AS (SELECT tree_id, parent_id AS node_id, avg(reward) AS m FROM {prefix}2 GROUP BY ALL),
  {prefix}1 AS (SELECT n.* REPLACE (coalesce(m, n.reward) AS reward) FROM {source} n
    LEFT JOIN {prefix}m1 x ON x.tree_id = n.tree_id AND x.node_id = n.node_id WHERE depth = 1),
  {prefix}m0 AS (SELECT tree_id, parent_id AS node_id, avg(reward) AS m FROM {prefix}1 GROUP BY ALL),
  {prefix}0 AS (SELECT n.* REPLACE (coalesce(m, n.reward) AS reward) FROM {source} n
    LEFT JOIN {prefix}m0 x ON x.tree_id = n.tree_id AND x.node_id = n.node_id WHERE depth = 0),
  {prefix}p AS MATERIALIZED (SELECT * FROM {prefix}0 UNION ALL SELECT * FROM {prefix}1 UNION ALL SELECT * FROM {prefix}2)"""


def fitness_sql(source: str, prefix: str, spread: str = ">= 0.1") -> str:
    return f"""{prefix}inner AS (SELECT DISTINCT tree_id, parent_id AS node_id FROM {source} WHERE parent_id IS NOT NULL),
  {prefix}leaf AS (SELECT n.tree_id, avg(reward) AS p_hat, count(*) AS n_leaves FROM {source} n
    LEFT JOIN {prefix}inner i ON i.tree_id = n.tree_id AND i.node_id = n.node_id WHERE i.node_id IS NULL GROUP BY 1),
  {prefix}sib AS (SELECT *, max(reward) OVER w - min(reward) OVER w AS spread FROM {source} WHERE parent_id IS NOT NULL
    WINDOW w AS (PARTITION BY tree_id, parent_id)),
  {prefix}mom AS (SELECT tree_id, count(*) AS n, covar_pop(log_prob, reward) AS c, stddev_pop(log_prob) AS sx,
    stddev_pop(reward) AS sy FROM {prefix}sib WHERE spread {spread} AND log_prob IS NOT NULL GROUP BY 1),
  {prefix}rho AS (SELECT l.*, CASE WHEN n >= 2 THEN n ELSE 0 END AS n_nodes,
    CASE WHEN n >= 2 AND sx >= 1e-12 AND sy >= 1e-12 THEN c / (sx * sy) ELSE 0 END AS rho
    FROM {prefix}leaf l LEFT JOIN {prefix}mom m ON m.tree_id = l.tree_id),
  {prefix}fit AS MATERIALIZED (SELECT *, p_hat * (1 - p_hat) AS bern_var, p_hat * (1 - p_hat) * (1 - rho * rho) AS F,
    CASE WHEN p_hat <= 0 OR p_hat >= 1 THEN 0 ELSE 0.0 - (p_hat * log2(p_hat) + (1 - p_hat) * log2(1 - p_hat)) END AS H
    FROM {prefix}rho),
  {prefix}reg AS (SELECT *, CASE WHEN F <= 0.025 THEN CASE WHEN bern_var < 0.05 AND p_hat <= 0.5 THEN 'dead_wrong' ELSE 'dead_correct' END
    WHEN F <= 0.1 THEN 'stale' ELSE 'informative' END AS regime FROM {prefix}fit)"""


PROPAGATED_SQL = f"{NODES_SQL}, {propagate_sql('nodes', 'v')}"
FITNESS_SQL = f"{PROPAGATED_SQL}, {fitness_sql('vp', 'f')}"


def nodes(spark, sf_dir, without=None, placed=True):
    """The node table before rewards move up; orders of `without` and their lines are left out, their roots stay.

    Lines that are not `placed` have no name and no path, for those who read neither.
    """
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice"
    )
    li = lines(spark, sf_dir) if placed else table(spark, sf_dir, "lineitem").withColumn("pos", F.lit(None).cast("bigint"))
    li = li.select("l_orderkey", "pos", "l_quantity", "l_extendedprice")
    leaves = li.join(o, "l_orderkey")
    # Read by two levels.
    inner = stored(o.join(li.select("l_orderkey"), "l_orderkey", "left_semi"), "orders")
    present = inner
    if without is not None:
        leaves = leaves.join(without, "l_orderkey", "left_anti")
        present = inner.join(without, "l_orderkey", "left_anti")
    cust = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    order = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    scale = F.lit(100000.0)
    none = F.lit(None)
    roots = inner.select("o_custkey").distinct().select(
        F.col("o_custkey").alias("tree_id"), cust.alias("node_id"),
        none.cast("string").alias("parent_id"), F.lit(0).alias("depth"),
        F.lit(0.0).alias("reward"), none.cast("double").alias("log_prob"),
        F.array("o_custkey").alias("path"),
    )
    middle = present.select(
        F.col("o_custkey").alias("tree_id"), order.alias("node_id"), cust.alias("parent_id"),
        F.lit(1).alias("depth"), F.lit(0.0).alias("reward"),
        (F.lit(0.0) - F.col("o_totalprice") / scale).alias("log_prob"),
        F.array("o_custkey", "l_orderkey").alias("path"),
    )
    bottom = leaves.select(
        F.col("o_custkey").alias("tree_id"),
        F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("pos").cast("string")).alias("node_id"),
        order.alias("parent_id"), F.lit(2).alias("depth"),
        F.when(F.col("l_quantity") >= 45, 1.0).otherwise(0.0).alias("reward"),
        (F.lit(0.0) - F.col("l_extendedprice") / scale).alias("log_prob"),
        F.array("o_custkey", "l_orderkey", "pos").alias("path"),
    )
    return roots.unionByName(middle).unionByName(bottom)


def propagated(spark, sf_dir):
    return T.propagate_rewards(nodes(spark, sf_dir), DEPTH)


NODE_COLUMNS = ["tree_id", "node_id", "parent_id", "depth", "reward", "log_prob", "path", "is_leaf"]
# What the fitness of trees needs. Names and places of lines are left out, so that lines are not put in order.
FIT_COLUMNS = ["tree_id", "parent_id", "reward", "log_prob", "is_leaf"]


def settled(spark, sf_dir, columns=NODE_COLUMNS):
    """Propagated nodes as a stored table, for operators that read them several times."""
    placed = "node_id" in columns or "path" in columns
    return T.propagate_rewards(nodes(spark, sf_dir, placed=placed), DEPTH, keep=list(columns))


def classified(spark, sf_dir):
    return T.classify_tree(T.tree_fitness(settled(spark, sf_dir, FIT_COLUMNS)))


@QUERIES.add(
    "propagate_rewards",
    f"WITH {PROPAGATED_SQL} SELECT tree_id, node_id, depth, round(reward, 6) AS reward FROM vp",
)
def propagate_rewards(spark, sf_dir):
    return rounded(propagated(spark, sf_dir).select("tree_id", "node_id", "depth", "reward"))


@QUERIES.add(
    "sibling_advantage",
    f"""WITH {PROPAGATED_SQL}, s AS (SELECT *, avg(reward) OVER (PARTITION BY tree_id, parent_id) AS m FROM vp WHERE parent_id IS NOT NULL)
        SELECT tree_id, node_id, round((reward - m) / (m * (1 - m) + 1e-6), 4) + 0.0 AS advantage FROM s""",
)
def sibling_advantage(spark, sf_dir):
    out = T.sibling_advantage(settled(spark, sf_dir))
    return rounded(out.select("tree_id", "node_id", "advantage"), 4)


@QUERIES.add(
    "prune_flat_siblings",
    f"""WITH {PROPAGATED_SQL}, s AS (SELECT *, max(reward) OVER w - min(reward) OVER w AS spread FROM vp
          WHERE parent_id IS NOT NULL WINDOW w AS (PARTITION BY tree_id, parent_id))
        SELECT tree_id, node_id, depth FROM s WHERE spread >= 0.1""",
)
def prune_flat_siblings(spark, sf_dir):
    return T.prune_flat_siblings(settled(spark, sf_dir)).select("tree_id", "node_id", "depth")


@QUERIES.add("level_sizes", f"WITH {NODES_SQL} SELECT depth, count(*) AS n FROM nodes GROUP BY 1")
def level_sizes(spark, sf_dir):
    return T.level_sizes(nodes(spark, sf_dir))


@QUERIES.add(
    "walk_order",
    f"""WITH {NODES_SQL} SELECT tree_id, node_id, depth, row_number() OVER (PARTITION BY tree_id ORDER BY path) - 1 AS place FROM nodes""",
)
def walk_order(spark, sf_dir):
    return T.walk_order(nodes(spark, sf_dir), DEPTH)


@QUERIES.add(
    "open_frontier",
    f"""WITH {NODES_SQL}, e AS (SELECT n.*, o_orderstatus = 'F' AS is_end FROM nodes n
          JOIN orders ON 'o' || o_orderkey = node_id) SELECT tree_id, node_id FROM e WHERE depth = 1 AND NOT is_end""",
)
def open_frontier(spark, sf_dir):
    ends = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node_id"),
        (F.col("o_orderstatus") == "F").alias("is_end"),
    )
    tagged = nodes(spark, sf_dir).join(ends, "node_id", "left").fillna({"is_end": False})
    return T.open_frontier(tagged, 1).select("tree_id", "node_id")


@QUERIES.add("node_to_root", f"WITH {NODES_SQL} SELECT node_id, 'c' || tree_id AS root_id FROM nodes")
def node_to_root(spark, sf_dir):
    return T.node_to_root(nodes(spark, sf_dir).select("node_id", "parent_id"), DEPTH)


@QUERIES.add(
    "leaf_rewards",
    f"""WITH {PROPAGATED_SQL}, {fitness_sql('vp', 'f')} SELECT tree_id, n_leaves, round(p_hat, 6) AS p_hat FROM fleaf""",
)
def leaf_rewards(spark, sf_dir):
    return rounded(T.leaf_rewards(propagated(spark, sf_dir)))


@QUERIES.add(
    "step_log_prob",
    """SELECT l_orderkey AS node_id, round(sum(CASE WHEN l_linestatus = 'O' THEN 0.0 - l_discount ELSE 0 END) + 0.0, 6) AS log_prob
       FROM lineitem GROUP BY 1""",
)
def step_log_prob(spark, sf_dir):
    toks = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("node_id"), (F.lit(0.0) - F.col("l_discount")).alias("logp"),
        (F.col("l_linestatus") == "O").cast("int").alias("mask"),
    )
    return T.step_log_prob(toks).select("node_id", F.round(F.col("log_prob") + 0.0, 6).alias("log_prob"))


_FIT_COLUMNS = """tree_id, round(p_hat, 6) AS p_hat, round(H, 6) AS H, round(bern_var, 6) AS bern_var,
  round(rho + 0.0, 6) AS rho, round(F, 6) AS F, n_leaves, CAST(n_nodes AS BIGINT) AS n_nodes"""


@QUERIES.add("tree_fitness", f"WITH {FITNESS_SQL} SELECT {_FIT_COLUMNS} FROM ffit")
def tree_fitness(spark, sf_dir):
    fit = T.tree_fitness(settled(spark, sf_dir, FIT_COLUMNS)).withColumn("rho", F.col("rho") + 0.0)
    return rounded(fit.withColumn("n_nodes", F.col("n_nodes").cast("bigint")))


@QUERIES.add(
    "tree_fitness_all_nodes",
    f"WITH {PROPAGATED_SQL}, {fitness_sql('vp', 'f', '>= 0')} SELECT {_FIT_COLUMNS} FROM ffit",
)
def tree_fitness_all_nodes(spark, sf_dir):
    fit = T.tree_fitness(settled(spark, sf_dir, FIT_COLUMNS), min_spread=None)
    fit = fit.withColumn("rho", F.col("rho") + 0.0)
    return rounded(fit.withColumn("n_nodes", F.col("n_nodes").cast("bigint")))


@QUERIES.add("classify_tree", f"WITH {FITNESS_SQL} SELECT tree_id, regime FROM freg")
def classify_tree(spark, sf_dir):
    return classified(spark, sf_dir).select("tree_id", "regime")


_SHARES = ", ".join(
    f"round(avg(CAST(regime = '{r}' AS INTEGER)), 6) AS {r}_share" for r in T.REGIMES
)


@QUERIES.add(
    "fitness_metrics",
    f"""WITH {FITNESS_SQL} SELECT c_nationkey, count(*) AS trees, round(avg(F), 6) AS mean_F, round(avg(p_hat), 6) AS mean_p,
        round(avg(rho) + 0.0, 6) AS mean_rho, {_SHARES} FROM freg JOIN customer ON c_custkey = tree_id GROUP BY 1""",
)
def fitness_metrics(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tree_id"), "c_nationkey")
    out = T.fitness_metrics(classified(spark, sf_dir).join(c, "tree_id"), ["c_nationkey"])
    return rounded(out.withColumn("mean_rho", F.col("mean_rho") + 0.0))


@QUERIES.add(
    "regime_table",
    f"""WITH {FITNESS_SQL} SELECT regime, count(*) AS n, round(avg(F), 6) AS mean_F,
        round(avg(c_acctbal) FILTER (WHERE c_acctbal > 0), 4) AS mean_norm, round(count(*) / (SELECT count(*) FROM freg), 6) AS share
        FROM freg JOIN customer ON c_custkey = tree_id GROUP BY 1""",
)
def regime_table(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("tree_id"), F.col("c_acctbal").alias("grad_norm_sq")
    )
    out = T.regime_table(classified(spark, sf_dir).join(c, "tree_id"))
    return rounded(out.withColumn("mean_norm", F.round("mean_norm", 4)))


_FAIL_SQL = """{p}bad AS (SELECT tree_id, parent_id AS node_id FROM {s} WHERE parent_id IS NOT NULL
    GROUP BY ALL HAVING max(reward) < 0.05),
  {p}first AS (SELECT n.tree_id, n.node_id, n.depth, n.path, row_number() OVER (PARTITION BY n.tree_id ORDER BY n.depth, n.path) AS rn
    FROM {p}bad b JOIN {s} n ON n.tree_id = b.tree_id AND n.node_id = b.node_id),
  {p}fail AS (SELECT * EXCLUDE (rn) FROM {p}first WHERE rn = 1)"""


@QUERIES.add(
    "shallowest_failure",
    f"WITH {PROPAGATED_SQL}, {_FAIL_SQL.format(p='x', s='vp')} SELECT tree_id, node_id, depth FROM xfail",
)
def shallowest_failure(spark, sf_dir):
    return T.shallowest_failure(settled(spark, sf_dir)).drop("path")


@QUERIES.add(
    "fitness_weights",
    f"""WITH {PROPAGATED_SQL}, {fitness_sql('vp', 'f')},
        adv AS MATERIALIZED (SELECT *, avg(reward) OVER w AS m, max(reward) OVER w - min(reward) OVER w AS spread FROM vp WHERE parent_id IS NOT NULL
          WINDOW w AS (PARTITION BY tree_id, parent_id)),
        j AS MATERIALIZED (SELECT a.tree_id, a.node_id, (reward - m) / (m * (1 - m) + 1e-6) AS advantage, coalesce(f.F, 1.0) AS F
          FROM adv a LEFT JOIN ffit f ON f.tree_id = a.tree_id WHERE spread >= 0.1),
        t AS (SELECT *, sum(F) OVER () AS s, count(*) OVER () AS n FROM j)
        SELECT tree_id, node_id, round(F / s * n, 6) AS weight, round(advantage * (F / s * n), 4) + 0.0 AS advantage FROM t""",
)
def fitness_weights(spark, sf_dir):
    # Siblings meet once, for advantages and fitness.
    tree = stored(T.with_sibling_stats(settled(spark, sf_dir, ["node_id", *FIT_COLUMNS])), "siblings")
    rows = T.sibling_advantage(tree, min_spread=T.MIN_SPREAD).select("tree_id", "node_id", "advantage")
    fit = T.tree_fitness(tree)
    weighted = A.fitness_weights(T.join_tree_weight(rows, fit), scale=("advantage",))
    return weighted.select(
        "tree_id", "node_id", F.round("weight", 6).alias("weight"), F.round("advantage", 4).alias("advantage")
    )


@QUERIES.add(
    "join_tree_weight",
    f"""WITH {PROPAGATED_SQL}, {fitness_sql('vp', 'f')} SELECT v.node_id, round(coalesce(f.F, 1.0), 6) AS F
        FROM vp v LEFT JOIN ffit f ON f.tree_id = v.tree_id""",
)
def join_tree_weight(spark, sf_dir):
    tree = settled(spark, sf_dir, ["node_id", *FIT_COLUMNS])
    fit = T.tree_fitness(tree)
    return rounded(T.join_tree_weight(tree, fit).select("node_id", "F"))


# --- trees of any depth: a chain of all lines of a supplier, most with a leaf beside it --------

_LINE_OF = "l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice"

DEEP_SQL = f"""deep AS MATERIALIZED (
    SELECT l_suppkey AS tree_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_LINE_OF}) - 1 AS k,
      count(*) OVER (PARTITION BY l_suppkey) AS n, l_quantity >= 20 AS has_leaf, l_linenumber % 2 = 0 AS leaf_first,
      CASE WHEN l_quantity >= 45 THEN 1.0 ELSE 0.0 END::DOUBLE AS leaf FROM lineitem),
  up AS (
    SELECT tree_id, k, CASE WHEN has_leaf THEN leaf ELSE 0.0 END AS v FROM deep WHERE k = n - 1
    UNION ALL SELECT d.tree_id, d.k, CASE WHEN has_leaf THEN (leaf + v) / 2 ELSE v END
    FROM up u JOIN deep d ON d.tree_id = u.tree_id AND d.k = u.k - 1),
  walk AS (SELECT *, k + count(*) FILTER (has_leaf AND leaf_first) OVER (PARTITION BY tree_id ORDER BY k
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS place,
      n - k + count(*) FILTER (has_leaf) OVER (PARTITION BY tree_id ORDER BY k
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS size FROM deep)"""


def deep_nodes(spark, sf_dir):
    """A tree per supplier as deep as it has lines."""
    order = [F.col(c) for c in _LINE_OF.split(", ")]
    rows = with_group_index(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, "k")
    name = lambda kind, k: F.concat_ws("-", F.lit(kind), "l_suppkey", k)
    none = F.lit(None).cast("double")
    chain = rows.select(
        F.col("l_suppkey").alias("tree_id"), name("s", F.col("k")).alias("node_id"),
        F.when(F.col("k") > 0, name("s", F.col("k") - 1)).alias("parent_id"),
        F.col("k").cast("int").alias("depth"), F.lit(0.0).alias("reward"), none.alias("log_prob"),
        F.array(F.lit(1)).alias("path"))
    leaves = rows.where("l_quantity >= 20").select(
        F.col("l_suppkey").alias("tree_id"), name("x", F.col("k")).alias("node_id"),
        name("s", F.col("k")).alias("parent_id"), (F.col("k") + 1).cast("int").alias("depth"),
        F.when(F.col("l_quantity") >= 45, 1.0).otherwise(0.0).alias("reward"), none.alias("log_prob"),
        F.array(F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(2)).alias("path"))
    return stored(chain.unionByName(leaves), "deep_nodes")


@QUERIES.add(
    "propagate_rewards_deep",
    f"""WITH RECURSIVE {DEEP_SQL} SELECT tree_id, 's-' || tree_id || '-' || k AS node_id, round(v, 6) AS reward FROM up
        UNION ALL SELECT tree_id, 'x-' || tree_id || '-' || k, leaf FROM deep WHERE has_leaf""",
)
def propagate_rewards_deep(spark, sf_dir):
    rows = deep_nodes(spark, sf_dir).select("tree_id", "node_id", "parent_id", "reward")
    return rounded(T.propagate_rewards(rows).select("tree_id", "node_id", "reward"))


@QUERIES.add(
    "node_to_root_deep",
    f"""WITH RECURSIVE {DEEP_SQL} SELECT 's-' || tree_id || '-' || k AS node_id, 's-' || tree_id || '-0' AS root_id FROM deep
        UNION ALL SELECT 'x-' || tree_id || '-' || k, 's-' || tree_id || '-0' FROM deep WHERE has_leaf""",
)
def node_to_root_deep(spark, sf_dir):
    return T.node_to_root(deep_nodes(spark, sf_dir))


@QUERIES.add(
    "walk_order_deep",
    f"""WITH RECURSIVE {DEEP_SQL} SELECT 's-' || tree_id || '-' || k AS node_id, place FROM walk
        UNION ALL SELECT 'x-' || tree_id || '-' || k, place + CASE WHEN leaf_first THEN 1 ELSE size - 1 END FROM walk WHERE has_leaf""",
)
def walk_order_deep(spark, sf_dir):
    return T.walk_order(deep_nodes(spark, sf_dir)).select("node_id", "place")


# --- grafting -----------------------------------------------------------------

GRAFT_SQL = f"""{NODES_SQL},
  bn AS (SELECT n.* FROM nodes n WHERE n.node_id NOT IN (SELECT 'o' || l_orderkey FROM ord WHERE o_orderpriority = '1-URGENT')
      AND (n.parent_id IS NULL OR n.parent_id NOT IN (SELECT 'o' || l_orderkey FROM ord WHERE o_orderpriority = '1-URGENT'))),
  {propagate_sql('bn', 'b')}, {fitness_sql('bp', 'bf')}, {_FAIL_SQL.format(p='x', s='bp')},
  refs AS (SELECT o_custkey AS tree_id, 'r' || l_orderkey AS node_id, max(CASE WHEN l_quantity >= 45 THEN 1.0 ELSE 0.0 END)::DOUBLE AS reward
    FROM kept WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
  heal AS (SELECT f.* FROM xfail f JOIN bfreg r ON r.tree_id = f.tree_id WHERE r.regime = 'dead_wrong'),
  gn AS (SELECT * FROM bp UNION ALL SELECT r.tree_id, r.node_id, h.node_id, h.depth + 1, r.reward, CAST(NULL AS DOUBLE), h.path
    FROM refs r JOIN heal h ON h.tree_id = r.tree_id),
  {propagate_sql('gn', 'g')}, {fitness_sql('gp', 'gf')},
  counts AS (SELECT r.tree_id, count(*) AS n_refinements, CAST(sum(CASE WHEN reward = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_correct
    FROM refs r JOIN heal h ON h.tree_id = r.tree_id GROUP BY 1),
  healed AS (SELECT b.tree_id, b.F AS F_before, g.F AS F_after, n_refinements, n_correct, b.regime AS before, g.regime AS after
    FROM counts c JOIN bfreg b ON b.tree_id = c.tree_id JOIN gfreg g ON g.tree_id = c.tree_id)"""


def grafted(spark, sf_dir):
    """Trees without urgent orders, which come back as refinements of dead trees."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey"
    )
    # By their keys: rows are shuffled by these anyway, and not once more by the names of all nodes.
    base = nodes(spark, sf_dir, urgent.select("l_orderkey"))
    refinements = (
        table(spark, sf_dir, "lineitem").join(urgent, "l_orderkey")
        .groupBy(F.col("o_custkey").alias("tree_id"),
                 F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("node_id"))
        .agg(F.max(F.when(F.col("l_quantity") >= 45, 1.0).otherwise(0.0)).alias("reward"))
    )
    return T.heal_trees(T.propagate_rewards(base, DEPTH, keep=NODE_COLUMNS), refinements, DEPTH)


@QUERIES.add(
    "graft_nodes",
    f"""WITH {GRAFT_SQL} SELECT tree_id, round(F_before, 6) AS F_before, round(F_after, 6) AS F_after, n_refinements, n_correct, before, after FROM healed""",
)
def graft_nodes(spark, sf_dir):
    return rounded(grafted(spark, sf_dir))


_RANKS = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@QUERIES.add(
    "healing_summary",
    f"""WITH {GRAFT_SQL}, d0 AS (SELECT *, round(F_after, 9) - round(F_before, 9) AS d FROM healed),
        d AS (SELECT *, {_RANKS.format(c='n_correct')} AS rc, {_RANKS.format(c='d')} AS rd FROM d0)
        SELECT count(*) AS healed, CAST(sum(CAST(d > 0 AS INTEGER)) AS BIGINT) AS improved, round(avg(CAST(d > 0 AS INTEGER)), 6) AS success_rate,
          round(avg(F_before), 6) AS mean_before, round(avg(F_after), 6) AS mean_after, round(avg(d), 6) AS mean_delta,
          round(quantile_cont(d, 0.5), 6) AS median_delta, round(stddev_samp(d), 6) AS std_delta,
          round(CASE WHEN count(*) >= 3 AND stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END, 6) AS t_statistic,
          round(sum(n_correct) / sum(n_refinements), 6) AS refinement_accuracy,
          round(CASE WHEN count(*) < 3 THEN NULL WHEN stddev_pop(rc) = 0 OR stddev_pop(rd) = 0 THEN 0
            ELSE corr(rc, rd) END, 6) AS correct_delta_spearman FROM d""",
)
def healing_summary(spark, sf_dir):
    # Rounded so that equal changes tie in both engines.
    healed = grafted(spark, sf_dir).withColumns(
        {c: F.round(c, 9) for c in ("F_before", "F_after")}
    )
    return rounded(X.healing_summary(healed))


# --- correlations -------------------------------------------------------------


@QUERIES.add(
    "pearson_guarded",
    """SELECT o_custkey, round(CASE WHEN count(*) >= 2 AND stddev_pop(o_totalprice) >= 1e-12 AND stddev_pop(o_orderkey) >= 1e-12
         THEN covar_pop(o_totalprice, o_orderkey) / (stddev_pop(o_totalprice) * stddev_pop(o_orderkey)) ELSE 0 END, 6) AS r,
       count(*) AS n FROM orders GROUP BY 1""",
)
def pearson_guarded(spark, sf_dir):
    return rounded(X.pearson_guarded(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", ["o_custkey"]))


@QUERIES.add(
    "spearman",
    f"""WITH r AS (SELECT {_RANKS.format(c='l_quantity')} AS rx, {_RANKS.format(c='l_extendedprice')} AS ry FROM lineitem)
        SELECT round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM r""",
)
def spearman(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rounded(X.spearman(li, "l_quantity", "l_extendedprice"))




@QUERIES.add(
    "fitness_correlations",
    f"""WITH {FITNESS_SQL}, v AS (SELECT ln(1 + c_acctbal) AS g, round(F, 9) AS F, round(bern_var, 9) AS b, round(1 - rho * rho, 9) AS u
          FROM ffit JOIN customer ON c_custkey = tree_id WHERE c_acctbal > 0),
        r AS (SELECT {_RANKS.format(c='g')} AS rg, {_RANKS.format(c='F')} AS rf, {_RANKS.format(c='b')} AS rb, {_RANKS.format(c='u')} AS ru FROM v)
        SELECT 'F' AS term, round(corr(rf, rg), 5) AS spearman, count(*) AS n FROM r
        UNION ALL SELECT 'bern_var', round(corr(rb, rg), 5), count(*) FROM r
        UNION ALL SELECT 'unexplained', round(corr(ru, rg), 5), count(*) FROM r""",
)
def fitness_correlations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("tree_id"), F.col("c_acctbal").alias("grad_norm_sq")
    )
    # Rounded so that equal fitness values tie in both engines.
    fit = T.tree_fitness(settled(spark, sf_dir, FIT_COLUMNS)).withColumns(
        {
            "F": F.round("F", 9),
            "bern_var": F.round("bern_var", 9),
            "rho": F.sqrt(F.lit(1.0) - F.round(F.lit(1.0) - F.col("rho") * F.col("rho"), 9)),
        }
    )
    return rounded(X.fitness_correlations(fit.join(c, "tree_id")), 5)


# --- cutting responses ----------------------------------------------------------

_IDS = "list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS INTEGER))"


@QUERIES.add(
    "responses_to_nodes",
    f"""WITH d AS (SELECT doc_id, {_IDS} AS ids FROM documents),
        seg AS (SELECT doc_id, unnest(range(0, CAST(ceil(len(ids) / 64) AS BIGINT))) AS i, ids FROM d),
        cut AS (SELECT doc_id, i, ids[i * 64 + 1 : i * 64 + 64] AS s FROM seg),
        e AS (SELECT *, s[-1] = 3 AS is_end, coalesce(sum(CAST(s[-1] = 3 AS INTEGER)) OVER
          (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM cut)
        SELECT doc_id AS tree_id, CAST(i + 1 AS INTEGER) AS depth, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, ',')) AS segment, is_end,
          i > 0 AS has_parent FROM e WHERE ended = 0""",
)
def responses_to_nodes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("tree_id"), F.lit(0).alias("sample"),
        F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"), F.lit(1.0).alias("reward"),
    )
    out = T.responses_to_nodes(d, 64, None, 3)
    return out.select(
        "tree_id", "depth", F.size("segment").alias("n"),
        F.md5(F.array_join(F.col("segment").cast("array<string>"), ",")).alias("segment"), "is_end",
        (F.col("parent_id") != F.xxhash64("tree_id")).alias("has_parent"),
    )
