"""Operators on small literal frames, where an expected value can be written down."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gradeloom.functions import answers as A
from gradeloom.functions import code_text, sequences, text
from gradeloom.operators import advantages, contests, curation, evaluation, grading, shaping
from gradeloom.operators import similarity, statistics, token_stats, trees
from gradeloom.sources import problems, results


def column(spark, value, expression, kind="string"):
    """The value of a column expression over one literal."""
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(expression(F.col("x")).alias("y")).first()["y"]


# --- answers ------------------------------------------------------------------


@pytest.mark.parametrize(
    "given, want",
    [
        (r"so \boxed{1} or \boxed{\frac{1}{2}}.", r"\frac{1}{2}"),
        (r"\boxed{a{b}c} tail }", "a{b}c"),
        (r"\boxed{open", None),
        (r"\fbox{3}", None),
        ("nothing", None),
        (r"\boxed{}", ""),
    ],
)
def test_boxed_answer(spark, given, want):
    assert column(spark, given, A.boxed_answer) == want


def test_last_boxed_falls_back_to_fbox(spark):
    assert column(spark, r"x \fbox{3} y", A.last_boxed) == r"\fbox{3}"
    assert column(spark, r"\boxed 5 {z} y", A.last_boxed) == r"\boxed 5 {z}"


@pytest.mark.parametrize(
    "given, want",
    [
        (r"\frac12", r"\frac{1}{2}"),
        (r"\frac1{72}", r"\frac{1}{72}"),
        (r"\tfrac{1}{2}", r"\frac{1}{2}"),
        ("3/4", r"\frac{3}{4}"),
        ("03/4", "03/4"),
        ("0.5", r"\frac{1}{2}"),
        (".5", r"\frac{1}{2}"),
        ("x = 7", "7"),
        ("abc = 7", "abc=7"),
        (r"\sqrt3", r"\sqrt{3}"),
        (r"5\sqrt", r"5\sqrt"),
        (r"1 \frac", r"1 \frac"),
        (r"\frac3", r"\frac3"),
        (r"12 \text{ cm}", "12"),
        (r"90^\circ", "90"),
        (r"\text{ yes }", "yes"),
        (r"50\%", "50"),
        (r"\left( 1, 2 \right)", "(1,2)"),
    ],
)
def test_normalize_latex(spark, given, want):
    assert column(spark, given, A.normalize_latex) == want


@pytest.mark.parametrize(
    "given, want",
    [
        ("12 cm^2", "12"),
        ("1,234", "1234"),
        ("1,234,567", "1234567"),
        ("1,234,567,890", "1,234,567,890"),
        ("3 million", "3*10^6"),
        ("7 3/4", "7+3/4"),
        ("- 5", "-5"),
        ("4.0", "4"),
        ("{17}", "17"),
        (r"\text{Yes}", "yes"),
        ("A and B", "a,b"),
        ("2.50", "2.50"),
        ("1e3", "1000"),
    ],
)
def test_normalize_answer(spark, given, want):
    assert column(spark, given, A.normalize_answer) == want


@pytest.mark.parametrize(
    "given, truth, want",
    [
        ("(1, 2)", "(1,2)", True),
        ("[1,2)", "(1,2)", False),
        ("(1.0,x)", "(1,x)", True),
        ("(1,2,3)", "(1,2)", False),
        (r"\dfrac{1}{2}", "1/2", True),
        ("2/4", "1/2", False),
        ("", "3", False),
        (None, "3", False),
        ("3", None, False),
        ("3.0", "3", True),
    ],
)
def test_answers_match(spark, given, truth, want):
    df = spark.createDataFrame([(given, truth)], "g string, t string")
    assert df.select(A.answers_match(F.col("g"), F.col("t")).alias("y")).first()["y"] is want


def test_reward_takes_any_truth_and_a_tool_bonus(spark):
    df = spark.createDataFrame(
        [
            (r"<think>x</think> the answer is \boxed{24 + 14*x}", ["10", r"\boxed{24 + 14*x}"], True, 1.5),
            (r"<think>x</think> the answer is \boxed{10}", ["10", "24"], False, 1.0),
            (r"no thought \boxed{10}", ["10"], False, -1.0),
            (r"</think> \boxed{11}", ["10"], True, 0.0),
            (r"</think> eleven", ["10"], False, -1.0),
            (r"</think> \boxed{10}", [r"\boxed{open"], False, -2.0),
            (r"</think> \boxed{10}", None, False, -2.0),
        ],
        "r string, t array<string>, u boolean, want double",
    )
    got = A.reward_value(F.col("r"), F.col("t"), F.col("u"), format_error=-1.0, unknown=-2.0)
    for row in df.select("r", got.alias("got"), "want").collect():
        assert row["got"] == row["want"], row


def test_hash_answers(spark):
    assert column(spark, "x #### -1,234.5 y #### 7", A.hash_answer) == "-1234.5"
    assert column(spark, "no marker 7", A.hash_answer) is None
    flexible = lambda c: A.hash_answer(c, "flexible")
    assert column(spark, "a 12 b 7 .", flexible) == "7"
    assert column(spark, "only . here", flexible) == "."
    assert column(spark, "none", flexible) is None


@pytest.mark.parametrize(
    "answer, want", [("x+y", True), ("xyz", False), ("2^{10}", True), ("2^10^3", False), ("a^(2)", False)]
)
def test_evaluable(spark, answer, want):
    # Braces are gone before the test, so a braced power reads as its digits.
    if answer == "2^{10}":
        want = False
    assert column(spark, answer, A.is_evaluable) is want


# --- program text ---------------------------------------------------------------


def test_last_code_block(spark):
    t = "a\n```python\nfirst\n```\nb\n```\n second \n```"
    assert column(spark, t, code_text.last_code_block) == "second"
    assert column(spark, "none", code_text.last_code_block) is None


def test_strip_main_block(spark):
    t = "x = 1\nif __name__ == '__main__':\n    run()\n\n\tmore()\ny = 2\nif __name__ == \"__main__\": go()"
    assert column(spark, t, code_text.strip_main_block) == "x = 1\ny = 2"
    assert column(spark, "if __name__ == '__main__':\n  a\nb", code_text.strip_main_block) == "b"


@pytest.mark.parametrize(
    "out, want",
    [("1.0 2\nok", True), (" 1 2 \n ok\n", True), ("1 2", False), ("1 3\nok", False), ("one 2\nok", False)],
)
def test_output_matches(spark, out, want):
    df = spark.createDataFrame([(out, "1 2.00\nok")], "a string, b string")
    assert df.select(code_text.output_matches(F.col("a"), F.col("b")).alias("y")).first()["y"] is want


def test_longest_tests_keeps_short_lists(spark):
    pairs = [("a", "1"), ("ccc", "2"), ("bb", "3"), ("ddd", "4")]
    df = spark.createDataFrame([(pairs,)], "t array<struct<input:string,output:string>>")
    top = df.select(code_text.longest_tests(F.col("t"), 2).alias("t")).first()["t"]
    assert [p["output"] for p in top] == ["2", "4"]
    same = df.select(code_text.longest_tests(F.col("t"), 4).alias("t")).first()["t"]
    assert [p["output"] for p in same] == ["1", "2", "3", "4"]


def test_parse_tests_drops_bad_text(spark):
    df = spark.createDataFrame([('{"inputs": ["1"], "outputs": ["2"]}',), ("bad",), ("{}",)], "t string")
    got = [r["p"] is not None for r in df.select(code_text.parse_tests(F.col("t")).alias("p")).collect()]
    assert got == [True, False, False]


# --- text ---------------------------------------------------------------------


def test_labels_and_levels(spark):
    graded = lambda c: text.difficulty_from_label(c, text.GRADED_LEVELS)
    assert column(spark, "HARD", graded) == 7.3
    assert column(spark, "?", graded) == -1.0
    assert column(spark, "Level 4", text.difficulty_from_level) == 4.0
    assert column(spark, "Level ?", text.difficulty_from_level) == 0.0
    assert column(spark, "dp,*x,*1800,*9", text.difficulty_from_tags) == 1800
    assert column(spark, None, text.difficulty_from_tags) == 0


def test_user_turn(spark):
    kind = "array<struct<role:string,content:string>>"
    assert column(spark, [("system", "s"), ("user", "u"), ("user", "v")], text.user_turn, kind) == "u"
    assert column(spark, [("system", "s"), ("assistant", "a")], text.user_turn, kind) == "a"
    assert column(spark, [], text.user_turn, kind) == ""


def test_judge_scores(spark):
    kind = "array<string>"
    assert column(spark, ["3", "An ERROR", "5.0", "x"], text.mean_of_judge_scores, kind) == 4.0
    assert column(spark, ["error"], text.mean_of_judge_scores, kind) is None
    assert column(spark, ["7", "Error", "5", "7"], text.distinct_candidate_answers, kind) == ["7", "5"]
    assert column(spark, ["Solution not found"], text.distinct_candidate_answers, kind) is None


def test_log_lines_round_trip(spark):
    df = spark.createDataFrame([(3, 0.25, 2.0)], "s int, a double, b double")
    line = text.format_log_line(F.col("s"), {"critic/rewards/mean": F.col("a"), "b": F.col("b")})
    row = df.select(line.alias("l"), text.parse_log_line(line).alias("metrics"))
    assert row.first()["l"] == "step:3 - critic/rewards/mean:0.250 - b:2.000"
    best = token_stats.best_metric(row, "critic/rewards/mean", 0.2).first()
    assert (best["best"], best["passed"]) == (0.25, True)


# --- sequences ------------------------------------------------------------------


def test_padding_and_masks(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "ids array<int>")
    ids = F.col("ids")
    one = lambda c: df.select(c.alias("y")).first()["y"]
    assert one(sequences.pad_truncate(ids, 5, 0)) == [0, 0, 1, 2, 3]
    assert one(sequences.pad_truncate(ids, 5, 9, "right")) == [1, 2, 3, 9, 9]
    assert one(sequences.pad_truncate(ids, 2, 0, over="left")) == [2, 3]
    assert one(sequences.pad_truncate(ids, 2, 0, over="right")) == [1, 2]
    with pytest.raises(PySparkException):
        one(sequences.pad_truncate(ids, 2, 0))
    assert one(sequences.attention_mask(ids, 5)) == [0, 0, 1, 1, 1]
    assert one(sequences.strip_padding(F.array(*map(F.lit, [0, 0, 7, 8])), F.array(*map(F.lit, [0, 0, 1, 1])))) == [7, 8]
    assert one(sequences.place_reward(F.lit(4), F.lit(3), F.lit(2.5))) == [0.0, 0.0, 2.5, 0.0]
    mask = F.array(*map(F.lit, [1, 1, 1, 1, 1, 0, 0]))
    assert one(sequences.loss_mask(mask, F.lit(2), F.lit(3))) == [0, 1, 1, 1, 0, 0, 0]
    assert one(sequences.position_ids(F.array(*map(F.lit, [0, 0, 1, 1, 1, 0])))) == [0, 0, 0, 1, 2, 2]
    assert one(sequences.eos_mask(F.array(*map(F.lit, [0, 0, 2, 42, 3, 5, 1, 0, 0])), 1)) == [1] * 7 + [0, 0]
    roles, lengths = F.array(*map(F.lit, ["user", "assistant"])), F.array(F.lit(2), F.lit(3))
    assert one(sequences.chat_mask(roles, lengths, 4)) == [0, 0, 1, 1]
    assert one(sequences.chat_mask(roles, lengths, 7)) == [0, 0, 1, 1, 1, 0, 0]
    assert one(sequences.chat_labels(ids, F.array(*map(F.lit, [0, 1, 0])))) == [-100, 2, -100]


# --- advantages -----------------------------------------------------------------


def token_rows(spark, sequences_):
    rows = [(s, p, r, v) for s, seq in enumerate(sequences_) for p, (r, v) in enumerate(seq)]
    return spark.createDataFrame(rows, "seq_id bigint, pos bigint, reward double, value double")


def test_gae_known_values(spark):
    toks = token_rows(spark, [[(0.0, 0.1), (0.0, 0.2), (1.0, 0.3)]])
    got = advantages.gae_advantage(toks, 0.9, 0.95).orderBy("pos").collect()
    assert [round(r["advantage"], 8) for r in got] == [0.6515675, 0.6685, 0.7]
    assert [round(r["returns"], 8) for r in got] == [0.7515675, 0.8685, 1.0]


@pytest.mark.parametrize("gamma, lam", [(1.0, 1.0), (0.97, 0.9), (0.0, 0.5)])
def test_gae_blocks_agree_with_the_recurrence(spark, gamma, lam):
    rng = random.Random(5)
    seqs = [[(rng.random(), rng.random()) for _ in range(n)] for n in (1, 4, 5, 23)]
    got = {
        (r["seq_id"], r["pos"]): r["advantage"]
        for r in advantages.gae_advantage(token_rows(spark, seqs), gamma, lam, block=4).collect()
    }
    for s, seq in enumerate(seqs):
        carry = following = 0.0
        for p in range(len(seq) - 1, -1, -1):
            reward, value = seq[p]
            carry = reward + gamma * following - value + gamma * lam * carry
            following = value
            assert math.isclose(got[s, p], carry, abs_tol=1e-9)
    assert len(got) == 33


def rollouts(spark, rows):
    return spark.createDataFrame(rows, "uid string, sample int, reward double, n_tokens int")


def test_grpo_groups(spark):
    df = rollouts(spark, [("a", 0, 1.0, 5), ("a", 1, 0.0, 8), ("b", 0, 1.0, 5)])
    got = {(r["uid"], r["sample"]): r["advantage"] for r in advantages.grpo_advantage(df).collect()}
    s = math.sqrt(0.5) + 1e-6
    assert math.isclose(got["a", 0], 0.5 / s) and math.isclose(got["a", 1], -0.5 / s)
    assert got["b", 0] == 0.0
    cut = advantages.grpo_advantage(df, max_length=8)
    assert {r["advantage"] for r in cut.where("sample = 1").collect()} == {0.0}


def test_grpo_when_every_group_is_single(spark):
    df = rollouts(spark, [("a", 0, 1.0, 5), ("b", 0, 0.0, 8)])
    got = {r["uid"]: r["advantage"] for r in advantages.grpo_advantage(df).collect()}
    assert math.isclose(got["a"], 1.0 / (1.0 + 1e-6)) and got["b"] == 0.0
    assert {r["accuracy"] for r in advantages.prompt_accuracy(df).collect()} == {0.0}


def test_fitness_weights(spark):
    df = spark.createDataFrame([(0.1, 2.0), (0.3, 4.0)], "F double, advantage double")
    got = advantages.fitness_weights(df, scale=("advantage",)).orderBy("F").collect()
    assert [round(r["advantage"], 9) for r in got] == [1.0, 6.0]
    none = advantages.fitness_weights(df.withColumn("F", F.lit(0.0)), scale=("advantage",))
    assert {r["weight"] for r in none.collect()} == {1.0}


def test_masked_variance_needs_two_rows(spark):
    df = spark.createDataFrame([(1.0, 1), (3.0, 0)], "x double, mask int")
    with pytest.raises(PySparkException):
        token_stats.masked_stats(df, "x").collect()
    row = token_stats.masked_stats(df.withColumn("mask", F.lit(1)), "x").first()
    assert (row["masked_var"], row["masked_var_unbiased"]) == (1.0, 2.0)


def test_adaptive_coefficient_with_signs_and_zeros(spark):
    steps = spark.createDataFrame(
        [(1, 1.0, 10), (2, 0.0, 10), (3, 0.0, 100), (4, 0.0, 50), (5, 1.0, 1)], "step int, kl double, n int"
    )
    got = [r["kl_coef"] for r in token_stats.adaptive_kl_series(steps, 0.5, 0.1, 10.0).orderBy("step").collect()]
    want, value = [], 0.5
    for kl, n in [(1.0, 10), (0.0, 10), (0.0, 100), (0.0, 50), (1.0, 1)]:
        want.append(value)
        value *= 1 + min(max(kl / 0.1 - 1, -0.2), 0.2) * n / 10.0
    assert np.allclose(got, want)


def test_policy_loss_levels(spark):
    rows = [(1, 1, 0.0, 0.1, 1.0), (1, 1, 0.0, -0.5, -1.0), (2, 1, 0.0, 0.4, 2.0), (2, 0, 0.0, 9.0, 5.0)]
    df = spark.createDataFrame(rows, "seq_id int, mask int, old_logp double, logp double, advantage double")
    free = [-a * math.exp(d) for *_, d, a in rows]
    cut = [-a * min(max(math.exp(d), 0.8), 1.2) for *_, d, a in rows]
    loss = [max(f, c) for f, c in zip(free, cut)]
    by_token = token_stats.policy_loss_stats(df, 0.2).first()
    assert math.isclose(by_token["pg_loss"], sum(loss[:3]) / 3)
    assert math.isclose(by_token["pg_clipfrac"], sum(c > f for f, c in zip(free[:3], cut[:3])) / 3)
    by_seq = token_stats.policy_loss_stats(df, 0.2, token_level=False).first()
    assert math.isclose(by_seq["pg_loss"], ((loss[0] + loss[1]) / 2 + loss[2]) / 2)


# --- shaping --------------------------------------------------------------------


@pytest.mark.parametrize("n, divisor", [(6, 4), (8, 4), (3, 8), (1, 5)])
def test_pad_and_unpad(spark, n, divisor):
    df = spark.range(n)
    padded = shaping.pad_to_divisor(df, "id", divisor)
    rows = padded.collect()
    assert len(rows) % divisor == 0
    copies = sorted((r["pad_index"], r["id"]) for r in rows if r["is_pad"])
    assert copies == [(i, i % n) for i in range(-n % divisor)]
    assert sorted(r["id"] for r in shaping.unpad(padded).collect()) == list(range(n))


def test_repeat_orders(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx bigint, v string")
    order = lambda d: [r["v"] for r in d.orderBy("place").collect()]
    assert order(shaping.repeat_rows(df, "idx", 2)) == list("aabbcc")
    assert order(shaping.repeat_rows(df, "idx", 2, interleave=False)) == list("abcabc")


def test_chunk_needs_equal_parts(spark):
    got = shaping.chunk(spark.range(6), [F.col("id")], 3).orderBy("id").collect()
    assert [r["chunk"] for r in got] == [0, 0, 1, 1, 2, 2]
    with pytest.raises(PySparkException):
        shaping.chunk(spark.range(7), [F.col("id")], 3).collect()


def test_fold_round_trip(spark):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    folded = shaping.fold(df, [F.col("id")], 4)
    assert sorted(len(r["rows"]) for r in folded.collect()) == [2, 4, 4]
    back = shaping.unfold(folded).orderBy("fold", "place").collect()
    assert [r["id"] for r in back] == list(range(10))


def test_union_columns_rejects_conflicts(spark):
    a = spark.createDataFrame([(1, "x", 5)], "id int, s string, n int")
    b = spark.createDataFrame([(1, 5, 7)], "id int, n int, extra int")
    row = shaping.union_columns(a, b, "id").first()
    assert (row["s"], row["n"], row["extra"]) == ("x", 5, 7)
    with pytest.raises(PySparkException):
        shaping.union_columns(a.withColumn("n", F.lit(1)), b, "id").collect()
    with pytest.raises(PySparkException):
        shaping.union_columns(a, b.withColumn("id", F.lit(2)), "id").collect()


def lengths(spark, n=240):
    rng = random.Random(1)
    return spark.createDataFrame([(i, rng.randint(1, 900)) for i in range(n)], "id bigint, n bigint")


def test_balanced_groups_are_even(spark):
    df = lengths(spark)
    groups = shaping.balanced_groups(df, "n", "id", 8).groupBy("group").agg(
        F.count("id").alias("c"), F.sum("n").alias("s")
    ).collect()
    assert {r["c"] for r in groups} == {30} and len(groups) == 8
    row = shaping.balance_stats(df, "n", "id", 8).first()
    assert row["balanced_max"] - row["balanced_min"] <= row["minmax_diff"]
    assert row["balanced_max"] - row["balanced_min"] <= 900


def test_token_budget_groups_cover_every_row(spark):
    df = lengths(spark)
    got = shaping.token_budget_groups(df, "n", "id", 5000).collect()
    total = sum(r["n"] for r in got)
    assert sorted(r["id"] for r in got) == list(range(240))
    assert {r["group"] for r in got} == set(range(-(-total // 5000)))


def test_batches_drop_the_partial_one(spark):
    df = spark.range(10)
    kept = shaping.assign_batches(df, "id", 1, 4).collect()
    assert sorted((r["batch"], r["place"]) for r in kept) == [(b, p) for b in range(2) for p in range(4)]
    assert shaping.assign_batches(df, "id", 1, 4, drop_last=False).count() == 10


def test_splits_are_exact_and_repeatable(spark):
    df = spark.range(500)
    train, test = shaping.holdout_split(df, "id", 42, 75)
    ids = sorted(r["id"] for r in test.collect())
    assert len(ids) == 75 and train.count() == 425
    _, again = shaping.holdout_split(df.repartition(7), "id", 42, 75)
    assert sorted(r["id"] for r in again.collect()) == ids
    a, b = shaping.fraction_split(df, [F.col("id")], 0.8)
    assert (a.agg(F.max("id")).first()[0], b.count()) == (399, 100)
    everything, nothing = shaping.holdout_split(df, "id", 1, 500)
    assert (everything.count(), nothing.count()) == (0, 500)


def test_weighted_mixture_follows_the_weights(spark):
    df = spark.range(2000).withColumn("d", F.when(F.col("id") < 1500, "big").otherwise("small"))
    got = shaping.weighted_mixture(df, "d", "id", {"big": 1.0, "small": 3.0, "none": 9.0}, 11)
    share = got.where("d = 'small'").count() / 2000
    assert got.count() == 2000 and abs(share - 0.75) < 0.04
    assert got.where("d = 'small' and id < 1500").count() == 0


def test_samples(spark):
    df = spark.range(100)
    one = [r["id"] for r in shaping.sample_n(df, "id", 10, 3).collect()]
    two = [r["id"] for r in shaping.seeded_shuffle(df.repartition(9), "id", 3).limit(10).collect()]
    assert one == two and len(set(one)) == 10
    assert [r["id"] for r in shaping.log_sample(df, "id", 3).collect()] == one[:1]
    assert [r["id"] for r in shaping.head(df, [F.col("id")], 3).collect()] == [0, 1, 2]


def test_reorder_and_restore(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    places = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "id int, place int")
    moved = shaping.reorder(df, places, "id")
    assert [r["v"] for r in moved.collect()] == ["b", "c", "a"]
    assert [r["v"] for r in shaping.restore_order(moved, "id").collect()] == ["a", "b", "c"]


# --- similarity -----------------------------------------------------------------


def clustered(n, copies=0, seed=3):
    """Unit vectors around a few centres, so that pruning has something to prune."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    v = centres[rng.integers(0, 6, n)] + 0.25 * rng.normal(size=(n, 12))
    v[:copies] = v[0]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def vector_frame(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id bigint, vec array<double>")


def brute_force(queries, docs, k, tau, exclude_self):
    out = {}
    cos = np.round(queries @ docs.T, 12)
    for q in range(len(queries)):
        found = [(-cos[q, d], d) for d in range(len(docs)) if not (exclude_self and d == q)]
        found = [(s, d) for s, d in sorted(found) if tau is None or -s > tau][:k]
        out[q] = [d for _, d in found]
    return out


@pytest.mark.parametrize("copies", [0, 100])
@pytest.mark.parametrize("tau", [None, 0.8, 0.97])
def test_topk_equals_brute_force(spark, copies, tau):
    v = clustered(300, copies)
    df = vector_frame(spark, v)
    got = {q: [] for q in range(300)}
    rows = similarity.cosine_topk(df, df, 4, tau, exclude_self=True, block_rows=32).orderBy("rank")
    for r in rows.collect():
        got[r["query"]].append(r["doc"])
    assert got == brute_force(v, v, 4, tau, True)


def test_topk_between_two_tables(spark):
    q, d = clustered(40, seed=5), clustered(300, 100)
    got = {i: [] for i in range(40)}
    rows = similarity.cosine_topk(vector_frame(spark, q), vector_frame(spark, d), 3, block_rows=16)
    for r in rows.orderBy("rank").collect():
        got[r["query"]].append(r["doc"])
    assert got == brute_force(q, d, 3, None, False)


def test_clustered_vectors_are_not_copied_to_all_blocks(spark):
    """Without a threshold a query leaves out the clusters beyond its own k-th score."""
    rng = np.random.default_rng(1)
    centres = np.eye(8)
    v = np.repeat(centres, 40, axis=0) + 0.01 * rng.normal(size=(320, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    vectors = vector_frame(spark, v).select(F.col("id").alias("group"), "vec", F.lit(0.1).alias("reach"))
    tree = similarity.MetricTree(vectors, 320, 16)
    assert tree.leaves.count() == 320
    # A centre's vectors fall to the few pivots drawn from it; those of other centres are left out.
    assert tree.sizes.count() > 12 and tree.routed(vectors, 320).count() <= 5 * 320


def test_exclude_similar_equals_brute_force(spark):
    q, d = clustered(200, seed=5), clustered(90)
    kept = similarity.exclude_similar(vector_frame(spark, q), vector_frame(spark, d), 0.6, block_rows=16)
    want = [i for i in range(200) if (q[i] @ d.T).max() <= 0.6]
    assert sorted(r["id"] for r in kept.collect()) == want


def test_bad_items_need_a_close_match(spark):
    d = clustered(50)
    df = vector_frame(spark, d)
    bad = df.where("id in (3, 9)").select((F.col("id") + 1000).alias("id"), "vec")
    left = similarity.exclude_matched_bad(df, bad)
    assert sorted(r["id"] for r in left.collect()) == [i for i in range(50) if i not in (3, 9)]
    far = vector_frame(spark, -d[:1])
    with pytest.raises(PySparkException):
        similarity.exclude_matched_bad(df, far).collect()


def greedy(edges, n):
    targets, removed = {}, set()
    for s, d in edges:
        targets.setdefault(s, []).append(d)
    for i in range(n):
        if i not in removed:
            removed.update(targets.get(i, []))
    return sorted(removed)


def test_removal_follows_id_order(spark):
    rng = random.Random(9)
    edges = [(i, j) for i in range(60) for j in rng.sample(range(60), 2) if i != j]
    edges += [(i, i + 1) for i in range(20)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = sorted(r["id"] for r in similarity.removed_in_order(df).collect())
    assert got == greedy(edges, 60)


# --- trees ------------------------------------------------------------------------


def node_frame(spark, rows):
    schema = "tree_id int, node_id string, parent_id string, depth int, reward double, log_prob double, path array<int>"
    return spark.createDataFrame(rows, schema)


def small_tree(spark):
    return node_frame(
        spark,
        [
            (1, "r", None, 0, 0.0, None, [0]),
            (1, "a", "r", 1, 0.0, None, [0, 0]),
            (1, "b", "r", 1, 1.0, None, [0, 1]),
            (1, "a0", "a", 2, 0.0, None, [0, 0, 0]),
            (1, "a1", "a", 2, 1.0, None, [0, 0, 1]),
            (1, "c", "r", 1, 0.0, None, [0, 2]),
            (1, "c0", "c", 2, 0.0, None, [0, 2, 0]),
            (1, "c1", "c", 2, 0.0, None, [0, 2, 1]),
        ],
    )


def test_rewards_move_up(spark):
    got = {r["node_id"]: r["reward"] for r in trees.propagate_rewards(small_tree(spark), 2).collect()}
    assert (got["a"], got["b"], got["c"], got["r"]) == (0.5, 1.0, 0.0, 0.5)


def test_tree_walk_frontier_and_roots(spark):
    tree = small_tree(spark)
    walk = [r["node_id"] for r in trees.walk_order(tree, 2).orderBy("place").collect()]
    assert walk == ["r", "a", "a0", "a1", "b", "c", "c0", "c1"]
    assert {r["root_id"] for r in trees.node_to_root(tree, 2).collect()} == {"r"}
    assert {r["depth"]: r["n"] for r in trees.level_sizes(tree).collect()} == {0: 1, 1: 3, 2: 4}
    leaves = trees.leaf_rewards(tree).first()
    assert (leaves["n_leaves"], leaves["p_hat"]) == (5, 0.4)


def test_failure_is_the_shallowest_in_order(spark):
    tree = trees.propagate_rewards(small_tree(spark), 2)
    row = trees.shallowest_failure(tree).first()
    assert (row["node_id"], row["depth"]) == ("c", 1)
    assert trees.shallowest_failure(tree, max_depth=1).count() == 0


def test_fitness_without_log_probs(spark):
    leaves = [(1, f"n{i}", "r", 1, float(i % 2), None, [0, i]) for i in range(4)]
    tree = trees.propagate_rewards(node_frame(spark, [(1, "r", None, 0, 0.0, None, [0]), *leaves]), 1)
    row = trees.classify_tree(trees.tree_fitness(tree)).first()
    assert (row["H"], row["bern_var"], row["F"], row["regime"]) == (1.0, 0.25, 0.25, "informative")
    assert (row["n_leaves"], row["n_nodes"], row["rho"]) == (4, 0, 0.0)


@pytest.mark.parametrize(
    "p, rho, want",
    [(1.0, 0.0, "dead_correct"), (0.0, 0.0, "dead_wrong"), (0.5, 1.0, "dead_correct"), (0.1, 0.0, "stale"), (0.4, 0.0, "informative")],
)
def test_regimes(spark, p, rho, want):
    var = p * (1 - p)
    df = spark.createDataFrame([(p, var, var * (1 - rho * rho))], "p_hat double, bern_var double, F double")
    assert trees.classify_tree(df).first()["regime"] == want


def test_responses_become_chains(spark):
    df = spark.createDataFrame(
        [(1, 0, [5, 6, 7, 8, 2], 1.0), (1, 1, [5, 2, 9, 9], 0.0), (1, 2, [5, 6, 7, 8, 9, 9, 9], 0.0)],
        "tree_id int, sample int, ids array<int>, reward double",
    )
    rows = trees.responses_to_nodes(df, 2, None, 2).orderBy("sample", "depth").collect()
    got = [(r["sample"], r["depth"], r["segment"], r["is_end"]) for r in rows]
    assert got == [
        (0, 1, [5, 6], False), (0, 2, [7, 8], False), (0, 3, [2], True),
        (1, 1, [5, 2], True),
        (2, 1, [5, 6], False), (2, 2, [7, 8], False), (2, 3, [9, 9], False),
        (2, 4, [9], False),
    ]
    by_id = {r["node_id"]: r for r in rows}
    assert all(r["depth"] == 1 or by_id[r["parent_id"]]["depth"] == r["depth"] - 1 for r in rows)
    open_nodes = trees.open_frontier(trees.responses_to_nodes(df, 2, 4, 2), 1).collect()
    assert sorted(r["sample"] for r in open_nodes) == [0, 2]


def test_healing_a_dead_tree(spark):
    tree = node_frame(
        spark,
        [(1, "r", None, 0, 0.0, None, [0]), (1, "a", "r", 1, 0.0, None, [0, 0]), (1, "b", "r", 1, 0.0, None, [0, 1])],
    )
    tree = trees.propagate_rewards(tree, 1)
    refinements = spark.createDataFrame([(1, "x", 1.0), (1, "y", 0.0), (2, "z", 1.0)], "tree_id int, node_id string, reward double")
    row = trees.heal_trees(tree, refinements, 1).collect()
    assert len(row) == 1 and row[0]["before"] == "dead_wrong" and row[0]["after"] == "informative"
    assert (row[0]["F_before"], row[0]["F_after"]) == (0.0, 0.1875)
    summary = statistics.healing_summary(trees.heal_trees(tree, refinements, 1)).first()
    assert (summary["healed"], summary["improved"], summary["refinement_accuracy"]) == (1, 1, 0.5)
    assert summary["t_statistic"] is None and summary["correct_delta_spearman"] is None
    healed = spark.createDataFrame(
        [(0.0, 0.1, 2, 1), (0.0, 0.2, 2, 2), (0.0, 0.0, 2, 0)],
        "F_before double, F_after double, n_refinements int, n_correct int",
    )
    ranked = statistics.healing_summary(healed).first()["correct_delta_spearman"]
    assert ranked == pytest.approx(1.0)


def test_hash_answers_are_scored(spark):
    rows = [("so #### 1,000", "1000", 1.0), ("#### 12 ", "13", 0.1), ("it is 13", "13", 0.0), (None, "1", 0.0)]
    df = spark.createDataFrame(rows, "text string, truth string, want double")
    score = A.hash_answer_score(F.col("text"), F.col("truth"), format_score=0.1)
    assert all(r["want"] == r["got"] for r in df.withColumn("got", score).collect())


def test_unequal_sample_counts_can_be_refused(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 0.0), (2, 1.0)], "uid int, reward double")
    assert evaluation.pass_at_k(df).first()["samples_min"] == 1
    with pytest.raises(PySparkException):
        evaluation.pass_at_k(df, equal_counts=True).collect()
    evaluation.pass_at_k(df.where("uid = 1"), equal_counts=True).collect()


def test_steps_of_one_side_stay(spark):
    roots = spark.createDataFrame([(1, 1.0)], "step int, reward double")
    responses = spark.createDataFrame([(2, 5)], "step int, n_tokens int")
    got = sorted(map(tuple, token_stats.step_totals(roots, responses).collect()))
    assert got == [(1, 1.0, None), (2, None, 5)]


# --- evaluation and contests ------------------------------------------------------


def test_pass_at_k(spark):
    df = rollouts(spark, [("a", 0, 1.0, 1), ("a", 1, 0.0, 1), ("b", 0, 0.0, 1), ("b", 1, 0.5, 1)])
    row = evaluation.pass_at_k(df).first()
    assert (row["pass_at_1"], row["pass_at_n"], row["samples_min"], row["samples_max"]) == (0.375, 0.5, 2, 2)


def test_pearson_guards(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 2.0), ("c", 2.0, 4.0)], "g string, x double, y double")
    got = {r["g"]: r["r"] for r in statistics.pearson_guarded(df, "x", "y", ["g"]).collect()}
    assert (got["a"], got["b"]) == (0.0, 0.0) and math.isclose(got["c"], 1.0)


def test_all_tests_pass(spark):
    df = spark.createDataFrame([(1, True), (1, True), (2, True), (2, False), (3, None)], "k int, passed boolean")
    got = {r["k"]: r["all_passed"] for r in grading.all_tests_pass(df, "k").collect()}
    assert got == {1: True, 2: False, 3: False}


def test_scores_of_failing_code_are_zero(spark):
    df = spark.createDataFrame([("4",), ("x",), (None,)], "a string")
    got = [r["score"] for r in grading.score_or_zero(df, lambda a: float(a) / 2, ["a"]).collect()]
    assert got == [2.0, 0.0, 0.0]


def test_contest_score(spark):
    s = spark.createDataFrame(
        [(1, "1A", [False, True]), (1, "1B", [True]), (1, "1C", [False, False, True]), (1, "1D", [False, True])],
        "contest bigint, problem_id string, statuses array<boolean>",
    )
    p = spark.createDataFrame(
        [(1, "1A", 500.0), (1, "1B", 40.0), (1, "1C", 900.0), (1, "1D", None)],
        "contest bigint, problem_id string, points double",
    )
    row = contests.contest_score(s, p, 2).first()
    assert (row["score"], row["penalty"]) == (450.0 + 40.0 + 1.0, 10.0)


def bisect_rating(ratings, rank):
    low, high = 0, max(ratings) + 100
    while high - low > 1:
        mid = (low + high) // 2
        if 1 + sum(1 / (1 + 10 ** ((mid - r) / 400)) for r in ratings) < rank:
            high = mid
        else:
            low = mid
    return low


def test_rating_search_ends_where_bisection_does(spark):
    rng = random.Random(4)
    changes, ranks, want = [], [], {}
    for c, rank in enumerate([0, 1, 2, 7, 30, 39, 40, 45]):
        ratings = [rng.randint(0, 3800) for _ in range(40)]
        changes += [(c, f"h{i}", r) for i, r in enumerate(ratings)]
        ranks.append((c, rank, 40))
        want[c] = bisect_rating(ratings, rank)
    got = contests.elo_rating(
        spark.createDataFrame(changes, "contest bigint, handle string, old_rating int"),
        spark.createDataFrame(ranks, "contest bigint, rank bigint, n bigint"),
    )
    assert {r["contest"]: r["elo"] for r in got.collect()} == want


def test_percentiles_count_strictly_lower_ratings(spark):
    ratings = spark.createDataFrame([(800.0, 3), (1200.0, 5), (1600.0, 2)], "rating double, n bigint")
    asked = spark.createDataFrame([(1, 1200.0), (2, 1200.5), (3, 0.0), (4, 9999.0)], "id bigint, rating double")
    got = {r["id"]: r["percentile"] for r in contests.rating_percentile(ratings, asked, "id").collect()}
    assert got == {1: 30.0, 2: 80.0, 3: 0.0, 4: 100.0}


def test_problem_ids_must_be_readable(spark):
    df = spark.createDataFrame([("1972D1",)], "problem_id string")
    assert contests.group_by_contest(df).first()["contest"] == 1972
    with pytest.raises(PySparkException):
        contests.group_by_contest(spark.createDataFrame([("D1",)], "problem_id string")).collect()


# --- sources ----------------------------------------------------------------------


def test_problem_sets_are_json_arrays(spark, tmp_path):
    folder = tmp_path / "train" / "math"
    folder.mkdir(parents=True)
    rows = [{"problem": "p", "answer": "1"}, {"problem": "q", "solution": "s", "difficulty": 2.5}]
    (folder / "aime.json").write_text(json.dumps(rows, indent=2))
    got = problems.read_problem_json(spark, str(tmp_path), "train", "math", "AIME")
    filled = curation.with_defaults(got.drop("dataset")).orderBy("problem").collect()
    assert [(r["answer"], r["solution"], r["difficulty"]) for r in filled] == [("1", "", -1.0), ("", "s", 2.5)]
    results.write_json_arrays(got.repartition(3), f"{tmp_path}/train/math/copy.json")
    again = problems.read_problem_json(spark, str(tmp_path), "train", "math", "copy")
    assert sorted(again.collect(), key=str) == sorted(got.collect(), key=str)


def test_histograms_stay_weighted(spark):
    df = spark.createDataFrame([('{"800": 12, "1200": 5}',)], "value string")
    got = {r["rating"]: r["n"] for r in problems.read_rating_histogram(df).collect()}
    assert got == {800.0: 12, 1200.0: 5}


def test_reuse_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "t")
    assert results.reuse_if_exists(spark, path, build).count() == 3
    assert results.reuse_if_exists(spark, path, build).count() == 3
    assert len(calls) == 1


def test_rl_examples_keep_the_declared_schema(spark):
    df = spark.createDataFrame([("q", "7", "because", 3)], "problem string, answer string, solution string, i int")
    ex = curation.build_rl_examples(df, "train", F.col("i"), F.lit("src"))
    want = spark.createDataFrame([], curation.RL_SCHEMA).schema
    assert ex.schema.simpleString() == want.simpleString()
    assert ex.schema["extra_info"].dataType["index"].dataType.simpleString() == "bigint"


def test_judge_votes_keep_rows_without_verdicts(spark):
    df = spark.createDataFrame([(1, ["[[1]]", "[[2]]"]), (2, ["[[2]]"]), (3, [])], "id int, votes array<string>")
    assert sorted(r["id"] for r in curation.filter_by_judge_votes(df, "votes", "[[1]]").collect()) == [1, 3]
    strict = curation.filter_by_judge_votes(df, "votes", "[[1]]", keep_unjudged=False)
    assert [r["id"] for r in strict.collect()] == [1]
