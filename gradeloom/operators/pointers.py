"""Pointer doubling: where the links of a table lead, in logarithmically many joins.

Each row links to another row, or ends. In a round every row takes over the link of the row it
points to, so its reach doubles; 5,000 links in a row take 13 rounds. Rows that arrived take no part in
later rounds but as targets. Every round is a written table, so a lost executor repeats
one round at most.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gradeloom.operators.skew import join_keyed
from gradeloom.session import stored

Combine = Callable[[dict[str, Column], dict[str, Column]], dict[str, Column]]


def counted(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, dict[str, int]]:
    """The frame as a written table, and how many of its rows meet each condition."""
    seen = Observation()
    table = stored(df.observe(seen, *[F.count_if(c).alias(n) for n, c in conditions.items()]), name)
    return table, seen.get


def followed(
    links: DataFrame, scope: list[str], carried: list[str] | None = None,
    combine: Combine | None = None, hot_rows: int | None = None,
) -> DataFrame:
    """Each row of (`scope`, `id`, `to`, `stop`, carried columns) with `to` at the first stop behind it.

    Rows with `stop` are where others arrive; a row without `to` is an end of its own and keeps a null.
    `combine` gives the carried columns over the way from a row to its target and on, from
    those of both (column by name). A link to no row, and a row that only leads into a cycle,
    are errors.
    """
    carried = carried or []
    columns = [*scope, "id", "to", "stop", *carried]
    rows = links.select(*columns, F.col("to").isNull().alias("arrived"))
    table, found = counted(rows, "links", left=~F.col("arrived"))
    done, moving, left = [table.where("arrived")], table.where("not arrived"), found["left"]
    while left:
        targets = reduce(DataFrame.unionByName, [*done, moving]).select(
            *scope, F.col("id").alias("to"),
            *[F.col(c).alias(f"__{c}") for c in ("to", "stop", "arrived", *carried)],
        )
        met = join_keyed(moving, targets, [*scope, "to"], "left", hot_rows)
        nowhere = F.concat(F.lit("no row is linked from "), F.col("id").cast("string"))
        stop = F.when(F.col("__stop").isNull(), F.raise_error(nowhere).cast("boolean")).otherwise(F.col("__stop"))
        # A row that neither stops nor goes on is an end for those behind it as well.
        ends = stop | F.col("__to").isNull()
        own = {c: F.col(c) for c in carried}
        beyond = {c: F.col(f"__{c}") for c in carried}
        over = combine(own, beyond) if combine else {}
        moved = met.select(
            *scope, "id", F.when(ends, F.col("to")).otherwise(F.col("__to")).alias("to"), "stop",
            *[F.when(ends, F.col(c)).otherwise(over[c]).alias(c) for c in carried],
            (ends | F.col("__arrived")).alias("arrived"),
        )
        table, found = counted(moved, "links", left=~F.col("arrived"))
        if found["left"] == left:
            # The row nearest to an end arrives in every round; these have none.
            lost = table.where("not arrived").first()["id"]
            raise ValueError(f"the links of {left} rows lead into a cycle, among them {lost}")
        done.append(table.where("arrived"))
        moving, left = table.where("not arrived"), found["left"]
    return reduce(DataFrame.unionByName, done).select(columns)


def components(edges: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """(`id`, `component`): the ids of (`src`, `dst`) and the lowest id each is connected with.

    In each round every id with a lower neighbour links to the lowest; following the links gives
    trees, whose roots take the place of their ids in the edges. Of the roots still
    connected at least half have a lower neighbour, so rounds follow the logarithm of the ids.
    """
    both = edges.select(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"))
    open_, found = counted(both.where("low < high").distinct(), "edges", left=F.lit(True))
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    known = stored(ids.select("id", F.col("id").alias("component")), "components")
    while found["left"]:
        lowest = open_.groupBy(F.col("high").alias("id")).agg(F.min("low").alias("to"))
        roots = open_.select(F.col("low").alias("id")).distinct().join(lowest, "id", "left_anti")
        links = lowest.select("id", "to", F.lit(False).alias("stop")).unionByName(
            roots.select("id", F.lit(None).cast(roots.schema["id"].dataType).alias("to"), F.lit(True).alias("stop")))
        at = followed(links, [], hot_rows=hot_rows).where("to is not null").select("id", F.col("to").alias("__root"))
        at = stored(at, "roots")

        def moved(rows: DataFrame, column: str) -> DataFrame:
            """The column at the root of its tree."""
            joined = join_keyed(rows, at.withColumnRenamed("id", column), [column], "left", hot_rows)
            return joined.withColumn(column, F.coalesce("__root", column)).drop("__root")

        known = stored(moved(known, "component"), "components")
        again = moved(moved(open_, "low"), "high").select(
            F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high"))
        open_, found = counted(again.where("low < high").distinct(), "edges", left=F.lit(True))
    return known


# Of this many links one is a splitter, on average.
SPLIT_ONE_OF = 32
# Lists with fewer links than this are not split again.
SMALL_LIST = 100_000


def list_ranks(links: DataFrame, scope: list[str], seed: int = 0) -> DataFrame:
    """Adds `rank` to rows of linked lists (`scope`, `id`, `to` the row before, `weight`): the weights before it.

    Splitters drawn by a hash of the id cut each list into short pieces. Every row finds the
    splitter before it, the splitters form a list of a thirty-second of the length, which is ranked in
    the same way, and each row adds its splitter's rank. A list's first row has no `to`.
    """
    key = F.xxhash64(*scope, "id", F.lit(seed))
    table, found = counted(
        links.select(*scope, "id", "to", "weight", (F.col("to").isNull() | (F.pmod(key, F.lit(SPLIT_ONE_OF)) == 0)).alias("stop")),
        "list", all=F.lit(True))
    small = found["all"] <= SMALL_LIST
    if small:
        table = table.withColumn("stop", F.col("to").isNull())
    # Carried: the weights from the target on, up to the row itself.
    before = table.select(*scope, F.col("id").alias("to"), F.col("weight").alias("way"))
    steps = table.join(before, [*scope, "to"], "left").select(*scope, "id", "to", "stop", "way")
    at = followed(steps, scope, ["way"], lambda own, beyond: {"way": own["way"] + beyond["way"]})
    if small:
        ranks = at.select(*scope, "id", F.coalesce("way", F.lit(0)).alias("rank"))
    else:
        at = stored(at, "pieces")
        # A splitter's way to the splitter before is its own row's weight in the shorter list, from there on.
        heads = at.where("stop").select(*scope, "id", "to", F.coalesce("way", F.lit(0)).alias("way"))
        following = heads.where("to is not null").select(*scope, F.col("to").alias("id"), F.col("way").alias("weight"))
        shorter = heads.drop("way").join(following, [*scope, "id"], "left").select(
            *scope, "id", "to", F.coalesce("weight", F.lit(0)).alias("weight"))
        top = list_ranks(shorter, scope, seed + 1).select(*scope, F.col("id").alias("to"), F.col("rank").alias("__rank"))
        own = list_rank_of_heads(heads, top, scope)
        others = at.where("not stop").join(top, [*scope, "to"]).select(
            *scope, "id", (F.col("__rank") + F.col("way")).alias("rank"))
        ranks = own.unionByName(others)
    return links.join(ranks, [*scope, "id"])


def list_rank_of_heads(heads: DataFrame, top: DataFrame, scope: list[str]) -> DataFrame:
    """The ranks of the splitters themselves."""
    return heads.select(*scope, F.col("id").alias("to")).join(top, [*scope, "to"]).select(
        *scope, F.col("to").alias("id"), F.col("__rank").alias("rank"))
