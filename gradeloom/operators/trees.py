"""Reward trees kept as node tables.

A node has `tree_id`, `node_id`, `parent_id` (null for a root), `depth`, `reward`,
`log_prob` and `path` (child places from the root). Where the caller promises shallow
trees (`max_depth` of `SHALLOW` or less), work on levels is one plan with a join per level. Without
that promise trees may have any depth: those that fit a task are settled there, many at a time
(`small_trees`); in others links are followed by doubling, chains are contracted
and tours are ranked, in rounds that grow with the logarithm of a tree's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.sequences import bernoulli_variance, binary_entropy
from gradeloom.operators import small_trees
from gradeloom.operators.pointers import counted, followed, list_ranks
from gradeloom.operators.skew import join_keyed, with_group_index, with_group_running, with_group_stats
from gradeloom.operators.statistics import pearson_of_moments
from gradeloom.session import stored

SIBLING_KEYS = ["tree_id", "parent_id"]
# Up to so many levels one plan joins level by level.
SHALLOW = 8
MIN_SPREAD = 0.1
REGIMES = ["dead_correct", "dead_wrong", "stale", "informative"]


def responses_to_nodes(
    responses: DataFrame, step_length: int, max_depth: int | None, eos: int
) -> DataFrame:
    """Cuts each response (`tree_id`, `sample`, `ids`, `reward`) into a chain of nodes.

    A node ends when its segment holds the end token last; nothing follows an ended
    node. A response of more than `max_depth` steps is an error, never cut; without a
    limit the depth follows from the responses.
    """
    steps = F.ceil(F.size("ids") / step_length).cast("int")
    if max_depth is not None:
        too_long = F.concat(F.lit(f"a response has more than {max_depth} steps: "), steps.cast("string"))
        steps = F.when(steps <= max_depth, steps).otherwise(F.raise_error(too_long))
    segments = F.transform(
        F.sequence(F.lit(0), steps - 1),
        lambda i: F.slice("ids", i * step_length + 1, F.lit(step_length)),
    )
    cut = responses.where(F.size("ids") > 0).withColumn("__segments", segments)
    # A segment that closes with the end token is the last of its chain.
    closing = F.array_position(
        F.transform("__segments", lambda s: F.element_at(s, -1) == eos), True
    )
    kept = F.when(closing > 0, F.slice("__segments", F.lit(1), closing.cast("int"))).otherwise(
        F.col("__segments")
    )
    # No row is without segments. Of an inner explode Spark infers a filter on their number and pushes it down
    # to the scan, where it would read the ids again for each segment.
    rows = cut.withColumn("__segments", kept).select(
        "tree_id", "sample", "reward", F.posexplode_outer("__segments").alias("place", "segment")
    )
    name = lambda depth: F.xxhash64("tree_id", "sample", depth)
    depth = F.col("place") + 1
    root = F.xxhash64("tree_id")
    return rows.select(
        "tree_id",
        name(depth).alias("node_id"),
        F.when(F.col("place") == 0, root).otherwise(name(F.col("place"))).alias("parent_id"),
        depth.alias("depth"),
        "sample",
        "segment",
        (F.element_at("segment", -1) == eos).alias("is_end"),
        "reward",
    )


def open_frontier(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of a level that did not end."""
    return nodes.where((F.col("depth") == depth) & ~F.col("is_end"))


def _within_depth(nodes: DataFrame, max_depth: int) -> DataFrame:
    """The nodes; reading one that lies deeper, or has no depth, is an error."""
    depth = F.col("depth")
    lost = F.concat(
        F.lit(f"a node is not within depth {max_depth}: "), F.coalesce(depth.cast("string"), F.lit("null"))
    )
    return nodes.withColumn("depth", F.when(depth <= max_depth, depth).otherwise(F.raise_error(lost)))


def _is_shallow(max_depth: int | None) -> bool:
    return max_depth is not None and max_depth <= SHALLOW


def _rooted(nodes: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The nodes of small trees with their roots, and all others.

    Node ids hold across trees: if one repeats, or a link leads from another tree into a small one, all are others.
    """
    if "tree_id" not in nodes.columns:
        return None, nodes
    repeated = nodes.groupBy(F.xxhash64("node_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        return None, nodes
    kind = nodes.schema["node_id"].dataType.simpleString()
    rows = nodes.select("tree_id", "node_id", "parent_id")
    done, others = small_trees.settled_in_groups(rows, small_trees.roots, f"root_id {kind}", "roots")
    if others is not None and done is not None:
        ids = others.select(F.col("node_id").alias("parent_id"))
        if not others.where("parent_id is not null").join(ids, "parent_id", "left_anti").isEmpty():
            return None, nodes
    return done if done is None else done.select("node_id", "root_id"), others


def node_to_root(nodes: DataFrame, max_depth: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Tags each node with its root.

    Shallow trees take one join per level, and a node that no root leads to within `max_depth`
    is an error. Otherwise small trees are settled in one task, many at a time, if there is a `tree_id`, and in
    others pointers to ancestors double their reach in each round; a parent that does not exist, and a
    cycle, are errors.
    """
    if not _is_shallow(max_depth):
        done, nodes = _rooted(nodes)
        if nodes is None:
            return done
        links = nodes.select(F.col("node_id").alias("id"), F.col("parent_id").alias("to"), F.col("parent_id").isNull().alias("stop"))
        roots = followed(links, [], hot_rows=hot_rows)
        roots = roots.select(F.col("id").alias("node_id"), F.coalesce("to", "id").alias("root_id"))
        return roots if done is None else roots.unionByName(done)
    tagged = nodes.where(F.col("parent_id").isNull()).select("node_id", F.col("node_id").alias("root_id"))
    levels = [tagged]
    for _ in range(max_depth):
        parents = levels[-1].select(F.col("node_id").alias("parent_id"), "root_id")
        children = nodes.select("node_id", "parent_id").join(parents, "parent_id")
        levels.append(children.select("node_id", "root_id"))
    found = reduce(DataFrame.unionByName, levels)
    lost = F.concat(F.lit(f"no root within {max_depth} levels of node "), F.col("node_id").cast("string"))
    return nodes.select("node_id").join(found, "node_id", "left").select(
        "node_id", F.coalesce("root_id", F.raise_error(lost)).alias("root_id")
    )


def level_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def _toured(rows: DataFrame, hot_rows: int | None) -> DataFrame:
    """Pre-order places of trees of any depth.

    The Euler tour enters and leaves each node once. Entering a child comes after entering
    its parent or leaving its earlier sibling; leaving a node after leaving its last child. The
    number of nodes entered before is the rank in that list.
    """
    children = with_group_index(
        rows.where(F.col("parent_id").isNotNull()), SIBLING_KEYS, [F.col("__child")], "__at", hot_rows)
    placed = stored(
        children.unionByName(rows.where(F.col("parent_id").isNull()).withColumn("__at", F.lit(None).cast("bigint"))), "placed")
    earlier = placed.where(F.col("__at").isNotNull()).select(
        *SIBLING_KEYS, (F.col("__at") + 1).alias("__at"), F.col("node_id").alias("__earlier"))
    last = placed.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.max_by("node_id", "__at").alias("__last"))

    def arc(node: str, entered: bool | Column) -> Column:
        entered = F.lit(entered) if isinstance(entered, bool) else entered
        return F.struct(F.col(node).alias("node"), entered.alias("entered"))

    enter = placed.join(earlier, [*SIBLING_KEYS, "__at"], "left").select(
        "tree_id", arc("node_id", True).alias("id"),
        F.when(F.col("__earlier").isNotNull(), arc("__earlier", False))
        .when(F.col("parent_id").isNotNull(), arc("parent_id", True)).alias("to"),
        F.lit(1).cast("bigint").alias("weight"))
    leave = placed.select("tree_id", "node_id").join(last, ["tree_id", "node_id"], "left").select(
        "tree_id", arc("node_id", False).alias("id"),
        F.when(F.col("__last").isNotNull(), arc("__last", False)).otherwise(arc("node_id", True)).alias("to"),
        F.lit(0).cast("bigint").alias("weight"))
    ranks = list_ranks(stored(enter.unionByName(leave), "tour"), ["tree_id"]).where("id.entered").select(
        "tree_id", F.col("id.node").alias("node_id"), F.col("rank").alias("place"))
    return placed.select("tree_id", "node_id", "depth").join(ranks, ["tree_id", "node_id"])


def _placed(nodes: DataFrame, hot_rows: int | None) -> DataFrame:
    """Pre-order places: small trees in groups, a tour around each other one."""
    child = F.col("path")[F.size("path") - 1]
    rows = nodes.select("tree_id", "node_id", "parent_id", "depth", child.alias("__child"))
    if dict(rows.dtypes)["__child"] not in small_trees.ID_TYPES:
        return _toured(rows, hot_rows)
    done, others = small_trees.settled_in_groups(rows, small_trees.places, "place bigint", "places")
    columns = ["tree_id", "node_id", "depth", "place"]
    if others is None:
        return done.select(columns)
    toured = _toured(others, hot_rows).select(columns)
    return toured if done is None else toured.unionByName(done.select(columns))


def walk_order(nodes: DataFrame, max_depth: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Place of each node in its tree's pre-order listing, from 0. No tree is sorted as a whole.

    In shallow trees subtree sizes go up level by level, then places come down: a child
    follows its parent and the subtrees of its earlier siblings. Others are placed in one task, many at
    a time; around one too large for that a tour is ranked as a list.
    """
    if not _is_shallow(max_depth):
        return _placed(nodes if max_depth is None else _within_depth(nodes, max_depth), hot_rows)
    keys = ["tree_id", "node_id"]
    nodes = _within_depth(nodes, max_depth)
    rows = nodes.select(*keys, "parent_id", "depth", F.col("path")[F.size("path") - 1].alias("__child"))
    sized, below = [], None
    for depth in range(max_depth, -1, -1):
        level = rows.where(F.col("depth") == depth).withColumn("__size", F.lit(1).cast("bigint"))
        if below is not None:
            inside = below.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(
                F.sum("__size").alias("__inside")
            )
            level = level.drop("__size").join(inside, keys, "left").select(
                *rows.columns, F.coalesce(F.col("__inside") + 1, F.lit(1).cast("bigint")).alias("__size")
            )
        below = level
        sized.append(level)
    tree = stored(reduce(DataFrame.unionByName, sized), "sized_nodes")
    children = with_group_running(
        tree.where(F.col("parent_id").isNotNull()), SIBLING_KEYS, [F.col("__child")],
        {"__earlier": F.col("__size")}, hot_rows,
    )
    above = tree.where(F.col("parent_id").isNull()).select(
        *keys, "depth", F.lit(0).cast("bigint").alias("place")
    )
    placed = [above]
    for depth in range(1, max_depth + 1):
        parents = above.select("tree_id", F.col("node_id").alias("parent_id"), "place")
        own = children.where(F.col("depth") == depth)
        above = join_keyed(own, parents, SIBLING_KEYS, hot_rows=hot_rows).select(
            *keys, "depth", (F.col("place") + 1 + F.col("__earlier")).cast("bigint").alias("place")
        )
        placed.append(above)
    return reduce(DataFrame.unionByName, placed)


def _mean_of(known: Column, n: Column, own: Column) -> Column:
    return F.when(n > 0, known / n).otherwise(own)


def _contracted(nodes: DataFrame, hot_rows: int | None) -> DataFrame:
    """(`tree_id`, `node_id`, `value`, `is_leaf`): rewards moved up trees of any depth.

    Each round rakes: settled nodes are added to the sums of their parents, and parents with no
    child open are settled. A parent with one child open is a link: its value is a function of that
    child's, x -> a x + b, or c where the child has none. Links are followed by doubling to the
    first node that is none, composing the functions, and take their value when that node is
    settled. After a round every open node but links has two open children or more, so
    rounds follow the logarithm of the leaves.
    """
    keys = ["tree_id", "node_id"]
    kids = nodes.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("open"))
    rows = nodes.select(*keys, "parent_id", F.col("reward").cast("double").alias("own")).join(kids, keys, "left")
    table, found = counted(rows, "tree", left=F.col("open").isNotNull())
    leaves = table.where("open is null")
    new = leaves.select(*keys, "parent_id", F.col("own").alias("value"))
    settled = [new.select(*keys, "value", F.lit(True).alias("is_leaf"))]
    zero = F.lit(0)
    branches = table.where("open is not null").withColumns(
        {"known": F.lit(0.0), "n": zero.cast("bigint")})
    none = F.lit(None)
    links = branches.limit(0).select(
        *keys, "parent_id", none.cast(nodes.schema["node_id"].dataType).alias("to"),
        *[none.cast("double").alias(c) for c in "abc"])
    left = found["left"]
    while left:
        up = new.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(
            F.sum("value").alias("__known"), F.count("value").alias("__n"), F.count(F.lit(1)).alias("__settled"))
        raked = branches.join(up, keys, "left").select(
            *keys, "parent_id", "own",
            (F.col("open") - F.coalesce("__settled", zero)).alias("open"),
            (F.col("known") + F.coalesce("__known", F.lit(0.0))).alias("known"),
            (F.col("n") + F.coalesce("__n", zero)).alias("n"))
        raked, found = counted(raked, "raked", single=F.col("open") == 1, many=F.col("open") > 1)
        ready = raked.where("open = 0").select(
            *keys, "parent_id", _mean_of(F.col("known"), F.col("n"), F.col("own")).alias("value"))
        branches = raked.where("open > 1")
        if found["single"]:
            single = raked.where("open = 1")
            # All nodes of these tables are yet to be added to their parent, so it is the only one there.
            child = raked.select(*keys, "parent_id").unionByName(
                links.select(*keys, "parent_id")).groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(
                F.min("node_id").alias("to"))
            n, known = F.col("n"), F.col("known")
            links = links.unionByName(single.join(child, keys).select(
                *keys, "parent_id", "to", (1.0 / (n + 1)).alias("a"), (known / (n + 1)).alias("b"),
                _mean_of(known, n, F.col("own")).alias("c")))
            links = stored(_composed(links, ready.unionByName(branches.select(*keys, "parent_id", none.cast("double").alias("value"))), hot_rows), "links")
        value = F.when(F.col("value").isNull(), F.col("c")).otherwise(F.col("a") * F.col("value") + F.col("b"))
        arrived = ready.select("tree_id", F.col("node_id").alias("to"), "value", F.lit(True).alias("__ready"))
        met, seen = counted(
            join_keyed(links, arrived, ["tree_id", "to"], "left", hot_rows).withColumn("value", value),
            "met", left=F.col("__ready").isNull())
        solved = met.where("__ready").select(*keys, "parent_id", "value")
        links = met.where("__ready is null").select(links.columns)
        new = stored(ready.unionByName(solved), "settled")
        settled.append(new.select(*keys, "value", F.lit(False).alias("is_leaf")))
        still, before = seen["left"] + found["many"], left
        if still == before:
            raise ValueError(f"{left} nodes have no leaf below them: their parents form a cycle")
        left = still
    return reduce(DataFrame.unionByName, settled)


def _composed(links: DataFrame, others: DataFrame, hot_rows: int | None) -> DataFrame:
    """The links with their function over the whole way to the first node that is no link."""
    def over(own: dict[str, Column], beyond: dict[str, Column]) -> dict[str, Column]:
        def through(x: Column) -> Column:
            return own["a"] * x + own["b"]

        c = F.when(beyond["c"].isNull(), own["c"]).otherwise(through(beyond["c"]))
        return {"a": own["a"] * beyond["a"], "b": through(beyond["b"]), "c": c, "parent_id": own["parent_id"]}

    carried = ["a", "b", "c", "parent_id"]
    stops = others.select("tree_id", F.col("node_id").alias("id"), F.lit(True).alias("stop"))
    rows = links.select("tree_id", F.col("node_id").alias("id"), "to", F.lit(False).alias("stop"), *carried)
    at = followed(rows.unionByName(stops, allowMissingColumns=True), ["tree_id"], carried, over, hot_rows)
    return at.where("not stop").select("tree_id", F.col("id").alias("node_id"), "parent_id", "to", "a", "b", "c")


def propagate_rewards(
    nodes: DataFrame, max_depth: int | None = None, hot_rows: int | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Every inner node takes the mean of its children, from the leaves up.

    The same join tells which nodes have no children: `is_leaf`. A child without a value counts
    for nothing; a node none of whose children has one keeps its own. In shallow trees levels are joined one
    after another, and a node deeper than `max_depth` is an error; others are settled in one task, many at a
    time, or contracted where a tree is too large for that.

    With `keep` the result is a stored table of those columns. Then each shallow level is written as soon as it is
    known, and the one above reads it, so none is computed again for those above; what only columns left out need is not computed.
    """
    if keep is not None and not _is_shallow(max_depth):
        return stored(propagate_rewards(nodes, max_depth, hot_rows).select(keep), "nodes")
    if not _is_shallow(max_depth):
        nodes = nodes.drop("is_leaf")
        if max_depth is not None:
            nodes = _within_depth(nodes, max_depth)
        rows = nodes.withColumn("reward", F.col("reward").cast("double"))
        done, others = small_trees.settled_in_groups(rows, small_trees.means, "is_leaf boolean", "rewards")
        if others is None:
            return done
        values = _contracted(others, hot_rows)
        moved = others.join(values, ["tree_id", "node_id"]).withColumn("reward", F.col("value")).select(*nodes.columns, "is_leaf")
        return moved if done is None else moved.unionByName(done)
    nodes = _within_depth(nodes.drop("is_leaf"), max_depth)
    below = nodes.where(F.col("depth") == max_depth).withColumn("is_leaf", F.lit(True))
    columns = below.columns
    # Besides what is kept, the level above groups by the parent.
    written = None if keep is None else [*keep, *(c for c in ("tree_id", "parent_id", "reward") if c not in keep)]
    done = []
    for depth in range(max_depth, -1, -1):
        if written is not None:
            below = stored(below.select(written), "level")
        done.append(below)
        if not depth:
            break
        means = below.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(
            F.avg("reward").alias("__mean")
        )
        level = nodes.where(F.col("depth") == depth - 1).join(means, ["tree_id", "node_id"], "left")
        below = level.withColumns(
            {"reward": F.coalesce("__mean", "reward"), "is_leaf": F.col("__mean").isNull()}
        ).select(columns)
    out = reduce(DataFrame.unionByName, done)
    return out if keep is None else out.select(keep)


def with_leaf_flag(nodes: DataFrame) -> DataFrame:
    """Marks nodes without children, unless they are marked already."""
    if "is_leaf" in nodes.columns:
        return nodes
    parents = (
        nodes.where(F.col("parent_id").isNotNull())
        .select("tree_id", F.col("parent_id").alias("node_id"))
        .distinct()
        .withColumn("__parent", F.lit(True))
    )
    marked = nodes.join(parents, ["tree_id", "node_id"], "left")
    return marked.withColumn("is_leaf", F.col("__parent").isNull()).drop("__parent")


def leaf_rewards(nodes: DataFrame) -> DataFrame:
    """Number and mean reward of each tree's leaves."""
    leaves = with_leaf_flag(nodes).where("is_leaf")
    return leaves.groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("n_leaves"), F.avg("reward").alias("p_hat")
    )


def with_sibling_stats(nodes: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Mean, lowest and highest reward among each node's siblings, unless the nodes have them already."""
    if "__mean" in nodes.columns:
        return nodes
    stats = {"__mean": F.avg("reward"), "__low": F.min("reward"), "__high": F.max("reward")}
    return with_group_stats(nodes, SIBLING_KEYS, stats, hot_rows)


def _with_siblings(nodes: DataFrame, hot_rows: int | None) -> DataFrame:
    return with_sibling_stats(nodes.where(F.col("parent_id").isNotNull()), hot_rows)


def _spread_kept(min_spread: float) -> Column:
    return (F.col("__high") - F.col("__low")) >= min_spread


def sibling_advantage(
    nodes: DataFrame, hot_rows: int | None = None, min_spread: float | None = None
) -> DataFrame:
    """(reward - m) / (m (1 - m) + 1e-6) with m the mean of the siblings.

    With `min_spread` only of children whose siblings differ that much, as `prune_flat_siblings` leaves them.
    """
    m = F.col("__mean")
    value = (F.col("reward") - m) / (bernoulli_variance(m) + F.lit(1e-6))
    rows = _with_siblings(nodes, hot_rows)
    if min_spread is not None:
        rows = rows.where(_spread_kept(min_spread))
    return rows.withColumn("advantage", value).drop("__mean", "__low", "__high")


def prune_flat_siblings(
    nodes: DataFrame, min_spread: float = MIN_SPREAD, hot_rows: int | None = None
) -> DataFrame:
    """Children whose siblings differ enough in reward."""
    return _with_siblings(nodes, hot_rows).where(_spread_kept(min_spread)).drop(
        "__mean", "__low", "__high"
    )


def step_log_prob(tokens: DataFrame, key: str = "node_id") -> DataFrame:
    """Sum of unmasked token log-probabilities of each node."""
    return tokens.groupBy(key).agg(F.sum(F.col("logp") * F.col("mask")).alias("log_prob"))


def tree_fitness(
    nodes: DataFrame, min_spread: float | None = MIN_SPREAD, hot_rows: int | None = None
) -> DataFrame:
    """Per tree: p, H, p(1-p), rho, F = p(1-p)(1-rho^2), counts.

    `nodes` carry propagated rewards. Rho is taken over non-root nodes with a
    log-probability, after pruning flat siblings unless `min_spread` is None.
    """
    flagged = with_leaf_flag(nodes)
    used = flagged.withColumn("__used", F.col("parent_id").isNotNull() & F.col("log_prob").isNotNull())
    if min_spread is not None:
        # A root stands alone under its null parent; it is not used in any case.
        used = with_sibling_stats(used, hot_rows).withColumn("__used", F.col("__used") & _spread_kept(min_spread))
    x = F.when(F.col("__used"), F.col("log_prob"))
    y = F.when(F.col("__used"), F.col("reward"))
    per = used.groupBy("tree_id").agg(
        F.avg(F.when(F.col("is_leaf"), F.col("reward"))).alias("p_hat"),
        F.sum(F.col("is_leaf").cast("bigint")).alias("n_leaves"),
        F.sum(F.col("__used").cast("bigint")).alias("__n"),
        pearson_of_moments(x, y).alias("rho"),
    )
    p = F.col("p_hat")
    out = per.withColumns(
        {
            "H": binary_entropy(p),
            "bern_var": bernoulli_variance(p),
            "n_nodes": F.when(F.col("__n") >= 2, F.col("__n")).otherwise(0),
        }
    ).drop("__n")
    return out.withColumn("F", F.col("bern_var") * (F.lit(1.0) - F.col("rho") * F.col("rho")))


def regime(low: float = 0.025, high: float = 0.10, low_variance: float = 0.05) -> Column:
    """Regime of a tree from its `F`, `p_hat` and `bern_var`."""
    dead = F.when(
        (F.col("bern_var") < low_variance) & (F.col("p_hat") <= 0.5), "dead_wrong"
    ).otherwise("dead_correct")
    return (
        F.when(F.col("F") <= low, dead).when(F.col("F") <= high, "stale").otherwise("informative")
    )


def classify_tree(fitness: DataFrame, **thresholds: float) -> DataFrame:
    return fitness.withColumn("regime", regime(**thresholds))


def fitness_metrics(trees: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean fitness and the share of each regime."""
    shares = [
        F.avg((F.col("regime") == r).cast("double")).alias(f"{r}_share") for r in REGIMES
    ]
    return trees.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("trees"), F.avg("F").alias("mean_F"),
        F.avg("p_hat").alias("mean_p"), F.avg("rho").alias("mean_rho"), *shares,
    )


def regime_table(trees: DataFrame, norm: str = "grad_norm_sq") -> DataFrame:
    """Count, share, mean fitness and mean positive squared gradient norm per regime."""
    total = trees.agg(F.count(F.lit(1))).scalar()
    return trees.groupBy("regime").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("F").alias("mean_F"),
        F.avg(F.when(F.col(norm) > 0, F.col(norm))).alias("mean_norm"),
    ).withColumn("share", F.col("n") / total)


def shallowest_failure(nodes: DataFrame, eps: float = 0.05, max_depth: int | None = None) -> DataFrame:
    """Per tree, the first node in level order whose children all score below `eps`."""
    failing = (
        nodes.where(F.col("parent_id").isNotNull())
        .groupBy("tree_id", F.col("parent_id").alias("node_id"))
        .agg(F.max("reward").alias("best"))
        .where(F.col("best") < eps)
    )
    places = nodes if max_depth is None else nodes.where(F.col("depth") < max_depth)
    found = failing.join(places.select("tree_id", "node_id", "depth", "path"), ["tree_id", "node_id"])
    first = F.min(F.struct("depth", "path", "node_id"))
    return found.groupBy("tree_id").agg(first.alias("f")).select(
        "tree_id", F.col("f.node_id").alias("node_id"), F.col("f.depth").alias("depth"),
        F.col("f.path").alias("path"),
    )


def graft_nodes(nodes: DataFrame, failures: DataFrame, refinements: DataFrame) -> DataFrame:
    """Adds scored refinements (`tree_id`, `node_id`, `reward`) below the failing node."""
    at = failures.select(
        "tree_id", F.col("node_id").alias("parent_id"), (F.col("depth") + 1).alias("depth"), "path"
    )
    grafts = refinements.join(at, "tree_id")
    return nodes.unionByName(grafts.select(*[c for c in grafts.columns if c in nodes.columns]),
                             allowMissingColumns=True)


def heal_trees(
    nodes: DataFrame, refinements: DataFrame, max_depth: int, eps: float = 0.05
) -> DataFrame:
    """Grafts refinements onto dead-wrong trees and compares fitness before and after.

    `nodes` carry propagated rewards. Only the grafted trees are evaluated again.
    """
    before = stored(classify_tree(tree_fitness(nodes)), "fitness")
    dead = before.where(F.col("regime") == "dead_wrong").select("tree_id")
    dead_nodes = stored(nodes.join(dead, "tree_id", "left_semi"), "dead_nodes")
    failures = shallowest_failure(dead_nodes, eps)
    used = stored(refinements.join(failures.select("tree_id"), "tree_id", "left_semi"), "refinements")
    counts = used.groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("n_refinements"),
        F.sum((F.col("reward") == 1).cast("bigint")).alias("n_correct"),
    )
    grafted = graft_nodes(dead_nodes, failures, used).join(
        counts.select("tree_id"), "tree_id", "left_semi"
    )
    fitting = ["tree_id", "parent_id", "reward", "log_prob", "is_leaf"]
    after_nodes = propagate_rewards(grafted, max_depth, keep=fitting)
    after = classify_tree(tree_fitness(after_nodes))
    return counts.join(
        before.select("tree_id", F.col("F").alias("F_before"), F.col("regime").alias("before")),
        "tree_id",
    ).join(
        after.select("tree_id", F.col("F").alias("F_after"), F.col("regime").alias("after")),
        "tree_id",
    )


def join_tree_weight(rows: DataFrame, weights: DataFrame, column: str = "F") -> DataFrame:
    """The tree's value on each of its rows, 1.0 for an unknown tree."""
    joined = join_keyed(rows, weights.select("tree_id", column), ["tree_id"], "left")
    return joined.withColumn(column, F.coalesce(column, F.lit(1.0)))
