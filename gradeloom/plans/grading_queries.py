"""Answer grading over texts derived from `part`, `documents` and `orders`."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from gradeloom.functions import answers as A
from gradeloom.functions import code_text
from gradeloom.operators import grading
from gradeloom.operators.curation import filter_evaluable_answers
from gradeloom.plans.base import QuerySet, table

QUERIES = QuerySet()

# One pair of answers per part, in the forms graders meet. Reads the same in both engines.
_B = "chr(92)"
_CASES = [
    (f"{_B} || 'frac' || a || b", f"{_B} || 'frac{{' || a || '}}{{' || b || '}}'"),
    ("a || '/' || b", f"{_B} || 'frac{{' || a || '}}{{' || b || '}}'"),
    (f"{_B} || 'text{{' || p_name || '}}'", "upper(p_name)"),
    ("p_size || ' cm^2'", "'' || p_size"),
    ("a || ',' || lpad('' || p_size, 3, '0') || ',000'", "a || lpad('' || p_size, 3, '0') || '000'"),
    ("'(' || a || ', ' || b || ')'", "'(' || a || ',' || b || ')'"),
    ("'[' || a || '.0,2)'", "'(' || a || ',2)'"),
    ("'(' || a || '.0,' || p_name || ')'", "'(' || a || ',' || p_name || ')'"),
    ("p_size || '.0'", "'' || p_size"),
    ("'0.5'", f"{_B} || 'frac{{1}}{{2}}'"),
    ("'x = ' || p_size", "'' || p_size"),
    (f"{_B} || 'sqrt' || a || '+' || {_B} || 'sqrt{{' || b || '}}'",
     f"{_B} || 'sqrt{{' || a || '}}+' || {_B} || 'sqrt' || b"),
    (f"p_size || {_B} || '%'", "p_size || '%'"),
    ("'.' || p_size", "'0.' || p_size"),
    ("a || ' million'", "a || '*10^6'"),
    (f"{_B} || 'dfrac{{' || a || '}}{{' || b || '}}'", f"{_B} || 'tfrac{{' || a || '}}{{' || b || '}}'"),
    ("p_name", "p_brand"),
    ("'{{' || p_size || '}}'", "'' || p_size"),
    ("a || ' ' || b || '/7'", "a || '+' || b || '/7'"),
    ("'-  ' || p_size", "'-' || p_size"),
    (f"p_size || {_B} || 'frac'", f"p_size || {_B} || 'frac'"),
    (f"p_size || ' ' || {_B} || 'text{{ cm}}'", "'' || p_size"),
    (f"p_size || {_B} || 'text{{ a}}' || {_B} || 'text{{ b}}'", "'' || p_size"),
    ("'(1,000, ' || b || ')'", "'(1000,' || b || ')'"),
    (f"p_size || '^' || {_B} || 'circ'", "'' || p_size"),
    ("'1,' || lpad('' || p_size, 3, '0') || ',567,890'", "'1' || lpad('' || p_size, 3, '0') || '567890'"),
    ("a || 'x^{{' || b || '}}+y'", "a || 'x^' || b || '2'"),
    (f"'A and B or C' || {_B} || '$'", "'a,b,c'"),
    (f"{_B} || 'frac' || a", f"{_B} || 'frac' || a || '{{' || b || '}}'"),
    ("a || 'e2'", "a || '00'"),
    ("''", "''"),
]


def _case(side: int) -> str:
    arms = " ".join(
        f"WHEN {i} THEN {c[side].replace('{{', '{').replace('}}', '}')}" for i, c in enumerate(_CASES)
    )
    return f"CASE CAST(p_partkey % {len(_CASES)} AS INTEGER) {arms} END"


_DIGITS = [
    "p_partkey", "p_name", "p_brand", "p_size",
    "CAST(p_size % 9 + 1 AS VARCHAR(2)) AS a", "CAST(p_size % 7 + 1 AS VARCHAR(2)) AS b",
]
ANSWERS_SQL = f"""digits AS (SELECT {', '.join(_DIGITS)} FROM part),
  answers AS (SELECT p_partkey, p_size, {_case(0)} AS given, {_case(1)} AS truth FROM digits)"""


def answers(spark, sf_dir):
    """Given and true answers, one pair per part."""
    digits = table(spark, sf_dir, "part").selectExpr(
        *[e.replace("VARCHAR(2)", "STRING") for e in _DIGITS]
    )
    return digits.selectExpr("p_partkey", "p_size", f"{_case(0)} AS given", f"{_case(1)} AS truth")


# --- the checks, written step by step ---------------------------------------


def _steps(source: str, prefix: str, first: str, steps: list[str]) -> tuple[str, str]:
    """A chain of CTEs that rewrites column `t`; `@` stands for it."""
    ctes = [f"{prefix}0 AS (SELECT *, {first} AS t FROM {source})"]
    for i, step in enumerate(steps):
        ctes.append(f"{prefix}{i + 1} AS (SELECT * REPLACE (({step.replace('@', 't')}) AS t) FROM {prefix}{i})")
    return ", ".join(ctes), f"{prefix}{len(steps)}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _untext(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^\\\\text\\{{(.+?)\\}}$') THEN regexp_extract({x}, '^\\\\text\\{{(.+?)\\}}$', 1) ELSE {x} END"


def latex_check(source: str, prefix: str, column: str) -> tuple[str, str]:
    ctes, last = _steps(
        source, prefix, _strip(_untext(_strip(column))),
        [
            "replace(replace(replace(@, chr(10), ''), '\\!', ''), '\\\\', '\\')",
            "replace(replace(@, 'tfrac', 'frac'), 'dfrac', 'frac')",
            "replace(replace(@, '\\left', ''), '\\right', '')",
            "replace(replace(replace(@, '^{\\circ}', ''), '^\\circ', ''), '\\$', '')",
        ],
    )
    ctes += f""", {prefix}u AS (SELECT *, {_strip(_untext(_strip(column)))} AS raw,
        len(string_split(t, '\\text{{ ')) AS units FROM {last})"""
    more, last = _steps(
        f"{prefix}u", prefix + "m", "t",
        [
            "string_split(@, '\\text{ ')[1]",
            "replace(replace(replace(@, '\\%', ''), ' .', ' 0.'), '{.', '{0.')",
            "CASE WHEN starts_with(@, '.') THEN '0' || @ ELSE @ END",
        ],
    )
    more = more.replace(f"SELECT *, t AS t FROM {prefix}u", f"SELECT * FROM {prefix}u")
    ctes += f""", {more}, {prefix}e AS (SELECT * REPLACE (CASE WHEN len(string_split(t, '=')) = 2
        AND length(string_split(t, '=')[1]) <= 2 THEN string_split(t, '=')[2] ELSE t END AS t),
        t = '' AS was_empty FROM {last})"""
    ctes += f""", {prefix}s AS (SELECT * REPLACE (replace(regexp_replace(t, '\\\\sqrt([^{{])',
        '\\\\sqrt{{\\1}}', 'g'), ' ', '') AS t),
        list_contains(string_split(t, '\\sqrt')[2:], '') AS bare FROM {prefix}e)"""
    ctes += f""", {prefix}f AS (SELECT *, list_filter(string_split(t, '\\frac')[2:],
        lambda s: s = '' OR (length(s) = 1 AND s <> '{{'))[1] AS short FROM {prefix}s)"""
    ctes += f""", {prefix}g AS (SELECT * REPLACE (CASE WHEN short IS NULL THEN
        regexp_replace(regexp_replace(t, '\\\\frac([^{{])([^{{])', '\\\\frac{{\\1}}{{\\2}}', 'g'),
          '\\\\frac([^{{])\\{{', '\\\\frac{{\\1}}{{', 'g') ELSE t END AS t) FROM {prefix}f)"""
    ctes += f""", {prefix}h AS (SELECT *, CASE WHEN units > 2 THEN raw WHEN was_empty THEN ''
        WHEN bare OR short = '' THEN raw WHEN t = '0.5' THEN '\\frac{{1}}{{2}}'
        ELSE regexp_replace(t, '^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$', '\\\\frac{{\\1}}{{\\2}}') END
        AS {prefix}latex FROM {prefix}g)"""
    return ctes, f"{prefix}h"


def _commas(x: str) -> str:
    for _ in range(4):
        x = f"regexp_replace({x}, '([0-9])(,)([0-9][0-9][0-9])($|[^0-9])', '\\1\\3\\4', 'g')"
    return x


def _number(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^\\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*$') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def _is_int(x: str) -> str:
    n = f"({_number(_commas(x))})"
    return f"coalesce(abs({n} - round({n})) <= 1e-7, false)"


def plain_check(source: str, prefix: str, column: str) -> tuple[str, str]:
    steps = [
        "replace(replace(replace(replace(@, '\\%', '%'), '\\$', '$'), '$', ''), '%', '')",
        "replace(replace(@, ' or ', ' , '), ' and ', ' , ')",
        "replace(replace(replace(@, 'million', '*10^6'), 'billion', '*10^9'), 'trillion', '*10^12')",
    ]
    steps += [f"regexp_replace(@, '{u}(es)?(s)? *(\\^[0-9]+)?', '', 'g')" for u in A.UNITS]
    steps += [
        "regexp_replace(@, '\\^ *\\\\circ', '', 'g')",
        "CASE WHEN starts_with(@, '{') AND ends_with(@, '}') THEN substr(@, 2, length(@) - 2) ELSE @ END",
        "regexp_replace(@, ',\\\\! *', '', 'g')",
        f"CASE WHEN coalesce(abs({_number('@')} - round({_number('@')})) <= 1e-7, false) THEN CAST(CAST(round({_number('@')}) AS DECIMAL(38,0)) AS VARCHAR) ELSE @ END",
        "regexp_replace(@, '- *', '-', 'g')",
        "regexp_replace(@, '([0-9]) +([0-9])', '\\1+\\2', 'g')",
        "lower(replace(replace(replace(@, ' ', ''), '{', ''), '}', ''))",
        f"CASE WHEN {_is_int('@')} THEN CAST(CAST(trunc({_number("replace(@, ',', '')")}) AS DECIMAL(38,0)) AS VARCHAR) ELSE @ END",
    ]
    ctes, last = _steps(source, prefix, _untext(column), steps)
    ctes += f", {prefix}z AS (SELECT * EXCLUDE (t), t AS {prefix}plain FROM {last})"
    return ctes, f"{prefix}z"


def _tuple(x: str) -> str:
    plain = _commas(x)
    return f"""CASE WHEN {x} = '' THEN []::VARCHAR[] WHEN regexp_matches({plain}, '^[()\\[\\]][^()\\[\\]]+[()\\[\\]]$')
      THEN list_transform(string_split(substr({plain}, 2, length({plain}) - 2), ','), lambda s: {_strip('s')})
      ELSE [{plain}] END"""


_LATEX, _LATEX_LAST = latex_check("answers", "l", "given")


@QUERIES.add(
    "normalize_latex",
    f"WITH {ANSWERS_SQL}, {_LATEX} SELECT p_partkey, given, llatex AS latex FROM {_LATEX_LAST}",
)
def normalize_latex(spark, sf_dir):
    return answers(spark, sf_dir).select(
        "p_partkey", "given", A.normalize_latex(F.col("given")).alias("latex")
    )


_PLAIN, _PLAIN_LAST = plain_check("answers", "p", "given")


@QUERIES.add(
    "normalize_answer",
    f"WITH {ANSWERS_SQL}, {_PLAIN} SELECT p_partkey, given, pplain AS plain FROM {_PLAIN_LAST}",
)
def normalize_answer(spark, sf_dir):
    return answers(spark, sf_dir).select(
        "p_partkey", "given", A.normalize_answer(F.col("given")).alias("plain")
    )


def _match_sql() -> str:
    parts, source = [], "answers"
    for prefix, column in (("gl", "given"), ("tl", "truth")):
        ctes, source = latex_check(source, prefix, column)
        keep = f"{prefix}k AS (SELECT p_partkey, p_size, given, truth, {'gllatex, ' if prefix == 'tl' else ''}{prefix}latex FROM {source})"
        parts += [ctes, keep]
        source = f"{prefix}k"
    for prefix, column in (("gp", "given"), ("tp", "truth")):
        ctes, source = plain_check(source, prefix, column)
        parts.append(ctes)
    parts.append(f"""tuples AS (SELECT *, {_tuple('gpplain')} AS gs, {_tuple('tpplain')} AS ts FROM {source})""")
    frac = lambda x: f"regexp_matches({x}, '^-?[0-9]+.?/0*[1-9][0-9]*.?$')"
    pair = "p[1]", "p[2]"
    same = f"""CASE WHEN {frac(pair[0])} AND {frac(pair[1])} THEN {pair[0]} = {pair[1]}
      WHEN {_is_int(pair[0])} <> {_is_int(pair[1])} THEN false
      ELSE {pair[0]} = {pair[1]} OR coalesce(({_number(_commas(pair[0]))}) = ({_number(_commas(pair[1]))}), false) END"""
    parts.append(f"""matched AS (SELECT p_partkey, p_size, given, truth,
      gllatex = tllatex OR gpplain = tpplain OR (length(gpplain) > 0
        AND NOT (len(ts) > 1 AND (left(gpplain, 1) <> left(tpplain, 1) OR right(gpplain, 1) <> right(tpplain, 1)))
        AND len(gs) = len(ts)
        AND len(list_filter(list_transform(range(1, len(ts) + 1), lambda i: [ts[i], gs[i]]), lambda p: NOT coalesce({same}, false))) = 0)
      AS correct FROM tuples)""")
    return ", ".join(parts)


_MATCHED = f"{ANSWERS_SQL}, {_match_sql()}"


@QUERIES.add("answers_match", f"WITH {_MATCHED} SELECT p_partkey, given, truth, correct FROM matched")
def answers_match(spark, sf_dir):
    return answers(spark, sf_dir).select(
        "p_partkey", "given", "truth", A.answers_match(F.col("given"), F.col("truth")).alias("correct")
    )


@QUERIES.add(
    "split_tuple",
    f"""WITH {ANSWERS_SQL} SELECT p_partkey, array_to_string({_tuple('given')}, '|') AS elements,
        CAST(len({_tuple('given')}) AS INTEGER) AS n FROM answers""",
)
def split_tuple(spark, sf_dir):
    parts = A.split_tuple(F.col("given"))
    return answers(spark, sf_dir).select(
        "p_partkey", F.array_join(parts, "|").alias("elements"), F.size(parts).alias("n")
    )


@QUERIES.add(
    "reward_value",
    f"""WITH {_MATCHED} SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 0.0 WHEN correct THEN
        1.0 + CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS reward FROM matched""",
)
def reward_value(spark, sf_dir):
    a = answers(spark, sf_dir)
    think = F.when(F.col("p_size") % 10 == 0, "no tag ").otherwise("thoughts </think> so ")
    response = F.concat(think, F.lit("it is \\boxed{1} or \\boxed{"), "given", F.lit("}."))
    truths = F.array(F.concat(F.lit("\\boxed{"), "truth", F.lit("}")))
    reward = A.reward_value(response, truths, used_tool=F.col("p_size") % 2 == 0)
    return a.select("p_partkey", reward.alias("reward"))


@QUERIES.add(
    "filter_evaluable_answers",
    f"""WITH {ANSWERS_SQL}, {_PLAIN}, letters AS (SELECT *, replace(replace(pplain, 'sqrt', ''), 'frac', '') AS bare FROM {_PLAIN_LAST})
        SELECT p_partkey, given FROM letters
        WHERE len(list_distinct(list_filter(string_split(bare, ''), lambda c: regexp_matches(c, '^\\p{{L}}$')))) <= 2
        AND NOT contains(pplain, '^{{') AND NOT contains(pplain, '^(')
        AND NOT regexp_matches(pplain, '\\^[0-9]+\\^') AND NOT regexp_matches(pplain, '\\^[0-9][0-9]+')""",
)
def evaluable(spark, sf_dir):
    return filter_evaluable_answers(answers(spark, sf_dir), "given").select("p_partkey", "given")


# --- extraction over whole documents ----------------------------------------

# The marker lands in the middle of each text; braces of the tail follow it.
_BOXED_SQL = """marked AS (SELECT doc_id, lang,
  CASE CAST(doc_id % 5 AS INTEGER)
    WHEN 0 THEN text || '{' || chr(92) || 'boxed{' || doc_id || '}' || ' then ' || chr(92) || 'boxed{' || lang || '{' || doc_id || '{x}}y} end }' || text
    WHEN 1 THEN text || chr(92) || 'fbox{' || doc_id || '}' || text
    WHEN 2 THEN text || chr(92) || 'boxed{' || text
    WHEN 3 THEN text || chr(92) || 'boxed ' || doc_id || ' {z}' || text
    ELSE text END AS t FROM documents)"""


def marked(spark, sf_dir):
    expression = _BOXED_SQL.split("SELECT ", 1)[1].rsplit(" FROM documents)", 1)[0]
    doc_id, lang, case = [p.strip() for p in expression.split(",", 2)]
    return table(spark, sf_dir, "documents").selectExpr(doc_id, lang, case)


@QUERIES.add(
    "last_boxed",
    f"""WITH {_BOXED_SQL} SELECT doc_id,
      CASE CAST(doc_id % 5 AS INTEGER) WHEN 0 THEN chr(92) || 'boxed{{' || lang || '{{' || doc_id || '{{x}}}}y}}'
        WHEN 1 THEN chr(92) || 'fbox{{' || doc_id || '}}'
        WHEN 3 THEN chr(92) || 'boxed ' || doc_id || ' {{z}}' END AS span,
      CASE WHEN doc_id % 5 = 0 THEN lang || '{{' || doc_id || '{{x}}}}y' END AS answer,
      length(t) AS n FROM marked""",
)
def last_boxed(spark, sf_dir):
    return marked(spark, sf_dir).select(
        "doc_id",
        A.last_boxed(F.col("t")).alias("span"),
        A.boxed_answer(F.col("t")).alias("answer"),
        F.length("t").cast("bigint").alias("n"),
    )


@QUERIES.add(
    "hash_answer",
    """WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' #### -1,' || (doc_id + 100) || '.5 and #### 7 .'
         WHEN doc_id % 3 = 1 THEN ' 12 then ' || doc_id ELSE '' END AS t FROM documents)
       SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '-1' || (doc_id + 100) || '.5' END AS strict,
         coalesce(list_filter(regexp_extract_all(t, '(-?[0-9.,]+)', 1), lambda x: x <> '' AND x <> '.')[-1],
           regexp_extract_all(t, '(-?[0-9.,]+)', 1)[1]) AS flexible FROM t""",
)
def hash_answer(spark, sf_dir):
    tail = F.expr(
        "CASE WHEN doc_id % 3 = 0 THEN ' #### -1,' || (doc_id + 100) || '.5 and #### 7 .'"
        " WHEN doc_id % 3 = 1 THEN ' 12 then ' || doc_id ELSE '' END"
    )
    t = F.concat("text", tail)
    return table(spark, sf_dir, "documents").select(
        "doc_id", A.hash_answer(t).alias("strict"), A.hash_answer(t, "flexible").alias("flexible")
    )


@QUERIES.add(
    "hash_answer_score",
    """SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 0.1 WHEN 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS score
       FROM documents""",
)
def hash_answer_score(spark, sf_dir):
    """Answers that are right, wrong, missing, and right but for a separator."""
    tail = F.expr(
        "CASE doc_id % 4 WHEN 0 THEN ' #### ' || doc_id WHEN 1 THEN ' #### 0' || doc_id"
        " WHEN 2 THEN ' ' || doc_id ELSE ' #### ' || doc_id || ',000' END"
    )
    truth = F.expr("doc_id || if(doc_id % 4 = 3, '000', '')")
    score = A.hash_answer_score(F.concat("text", tail), truth, format_score=0.1)
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score"))


@QUERIES.add(
    "after_think",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN md5(' ' || text) WHEN lang = 'fr' THEN md5(source) END AS tail
       FROM documents""",
)
def after_think(spark, sf_dir):
    t = (
        F.when(F.col("lang") == "en", F.concat("text", F.lit("</think> "), "text"))
        .when(F.col("lang") == "fr", F.concat("text", F.lit("</think>"), "source", F.lit("</think>"), "text"))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(A.after_think(t)).alias("tail"))


@QUERIES.add(
    "last_code_block",
    f"""SELECT doc_id, CASE WHEN lang <> 'en' THEN md5({_strip("source || chr(10) || text")}) END AS code FROM documents""",
)
def last_code_block(spark, sf_dir):
    block = F.concat(
        "text", F.lit("\n```\nfirst\n```\n"), "lang", F.lit("```python\n"), "source", F.lit("\n"), "text", F.lit("\n```\nend")
    )
    t = F.when(F.col("lang") != "en", block).otherwise(F.concat("text", F.lit("``` open")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(code_text.last_code_block(t)).alias("code")
    )


@QUERIES.add(
    "strip_main_block",
    """SELECT doc_id, md5(source || chr(10) || text || CASE WHEN n_chars % 2 = 0 THEN chr(10) || 'tail()' ELSE '' END) AS code
       FROM documents""",
)
def strip_main_block(spark, sf_dir):
    guard = F.when(F.col("n_chars") % 3 == 0, 'if __name__ == "__main__":').otherwise(
        "  if __name__ == '__main__': run()"
    )
    indented = F.concat(F.lit("    "), F.regexp_replace("text", "\n", "\n\t"))
    tail = F.when(F.col("n_chars") % 2 == 0, F.lit("\ntail()")).otherwise(F.lit(""))
    code = F.concat(
        "source", F.lit("\n"), "text", F.lit("\n"), guard, F.lit("\n"), indented,
        F.lit("\n\n   \n"), F.lit("    done()"), tail,
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(code_text.strip_main_block(code)).alias("code")
    )


@QUERIES.add(
    "output_matches",
    """SELECT o_orderkey, o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_custkey % 2 = 0) AS correct FROM orders""",
)
def output_matches(spark, sf_dir):
    price, cust = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_custkey").cast("string")
    expected = F.concat(price.cast("string"), F.lit("  1\n"), cust)
    status = F.col("o_orderstatus")
    padded = F.concat(F.lit(" \n"), price.cast("string"), F.lit("00 1.0\n "), cust, F.lit(".000 \n"))
    off = F.concat(price.cast("string"), F.lit(" 1\n"), (F.col("o_custkey") + F.col("o_custkey") % 2).cast("string"))
    output = F.when(status == "F", padded).when(status == "O", off).otherwise(F.concat(price.cast("string"), F.lit(" one\n"), cust))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", code_text.output_matches(output, expected).alias("correct")
    )


@QUERIES.add(
    "all_tests_pass",
    """SELECT o.o_orderkey, coalesce(bool_and(l.l_returnflag <> 'R'), false) AND count(l.l_orderkey) > 0 AS all_passed
       FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey""",
)
def all_tests_pass(spark, sf_dir):
    verdicts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.bool_and(F.col("l_returnflag") != "R").alias("passed")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    joined = orders.join(verdicts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return grading.all_tests_pass(joined, "o_orderkey")


@QUERIES.add(
    "score_with",
    f"""WITH {_MATCHED} SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 0.25 WHEN correct THEN 1.0 ELSE 0.0 END::DOUBLE AS score
        FROM matched""",
)
def score_with(spark, sf_dir):
    rows = answers(spark, sf_dir).withColumn("score", F.when(F.col("p_size") % 10 == 0, 0.25))
    scorer = lambda g, t: A.answers_match(g, t).cast("double")
    return grading.score_with(rows, scorer, ["given", "truth"]).select("p_partkey", "score")


@QUERIES.add(
    "score_or_zero",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_custkey = 0 THEN 0.0 ELSE o_totalprice / o_custkey END AS score
       FROM orders""",
)
def score_or_zero(spark, sf_dir):
    def ratio(price, key, status):
        return None if status == "P" else price / key

    o = table(spark, sf_dir, "orders")
    scored = grading.score_or_zero(o, ratio, ["o_totalprice", "o_custkey", "o_orderstatus"])
    return scored.select("o_orderkey", "score")


@QUERIES.add(
    "score_or_zero_deadline",
    """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= 2 OR o_custkey = 0 THEN 0.0 ELSE o_totalprice / o_custkey END AS score
       FROM orders""",
)
def score_or_zero_deadline(spark, sf_dir):
    """The scorer hangs on the first two orders."""
    o = table(spark, sf_dir, "orders")
    hanging = {r[0] for r in o.select("o_orderkey").orderBy("o_orderkey").limit(2).collect()}

    def ratio(price, key, order):
        if order in hanging:
            time.sleep(3600)
        return price / key

    scored = grading.score_or_zero(o, ratio, ["o_totalprice", "o_custkey", "o_orderkey"], seconds=0.5)
    return scored.select("o_orderkey", "score")
