"""Answer extraction, normalisation and comparison as Column expressions.

Everything stays in the JVM: no Python runs per row. A regular expression that
starts a replacement keeps the order the grading rules need.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units removed from an answer, in this order.
UNITS = [
    "degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour",
    "day", "week", "month", "year", "foot", "feet", "inch", "yard",
]

# Words that stand for a power of ten.
MAGNITUDES = [("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]

NUMBER = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"


def swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value computed once per row.

    Column expressions are trees: a value used twice is a subtree written twice,
    and a chain of such steps doubles at each one. A one-element transform binds
    the value instead.
    """
    return F.transform(F.array(value), body)[0]


def chain(value: Column, *steps: Callable[[Column], Column]) -> Column:
    return reduce(let, steps, value)


# --- extraction -----------------------------------------------------------


def _close_brace(tail: Column) -> Column:
    """Length of the tail up to the brace that closes its first open one, or null.

    The tail is cut after each brace, so the fold visits braces, not characters.
    """
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("closed")
    )

    def step(state, piece):
        depth = state["depth"] + (
            F.when(F.endswith(piece, F.lit("{")), 1)
            .when(F.endswith(piece, F.lit("}")), -1)
            .otherwise(0)
        )
        return F.when(state["closed"], state).otherwise(
            F.struct(
                depth.alias("depth"),
                (state["length"] + F.length(piece)).alias("length"),
                (F.endswith(piece, F.lit("}")) & (depth == 0)).alias("closed"),
            )
        )

    return F.aggregate(
        F.split(tail, r"(?<=[{}])"), start, step, lambda s: F.when(s["closed"], s["length"])
    )


def last_boxed(text: Column) -> Column:
    r"""The last `\boxed{...}` (else the last `\fbox{...}`) up to its closing brace.

    Null when there is none or its braces never close.
    """

    def span(text):
        boxed = F.contains(text, F.lit(r"\boxed"))
        marker = F.when(boxed, F.lit(r"\boxed")).when(
            F.contains(text, F.lit(r"\fbox")), F.lit(r"\fbox")
        )
        tail = F.when(boxed, F.substring_index(text, r"\boxed", -1)).otherwise(
            F.substring_index(text, r"\fbox", -1)
        )
        return let(
            F.struct(marker.alias("marker"), tail.alias("tail")),
            lambda c: F.concat(
                c["marker"], F.substring(c["tail"], F.lit(1), _close_brace(c["tail"]))
            ),
        )

    return let(text, span)


def boxed_answer(text: Column) -> Column:
    r"""Content of the last `\boxed{...}`; null where none opens with `\boxed{`."""
    return let(
        last_boxed(text),
        lambda span: F.when(
            F.startswith(span, F.lit(r"\boxed{")),
            F.substring(span, F.lit(8), F.length(span) - F.lit(8)),
        ),
    )


def hash_answer(text: Column, method: str = "strict") -> Column:
    """Number after the first `#### ` (strict), or the last number (flexible)."""
    if method == "strict":
        found = F.regexp_extract(text, r"#### (-?[0-9.,]+)", 1)
        return F.when(found != "", F.regexp_replace(found, "[,$]", ""))
    if method != "flexible":
        raise ValueError(f"unknown method {method}")
    numbers = F.regexp_extract_all(text, F.lit(r"(-?[0-9.,]+)"), F.lit(1))
    return let(
        numbers,
        lambda all_: F.coalesce(
            F.try_element_at(F.filter(all_, lambda n: ~n.isin("", ".")), F.lit(-1)),
            F.try_element_at(all_, F.lit(1)),
        ),
    )


def hash_answer_score(
    text: Column, truth: Column, method: str = "strict", score: float = 1.0, format_score: float = 0.0
) -> Column:
    """`score` for the true number, `format_score` for another one, 0 for none."""
    return let(
        hash_answer(text, method),
        lambda found: F.when(found.isNull(), 0.0)
        .when(found == truth, float(score))
        .otherwise(float(format_score)),
    )


def after_think(text: Column, ignore_think: bool = False) -> Column:
    """Text after the first closing think tag (up to a second); null if absent."""
    if ignore_think:
        return text
    tag = F.lit("</think>")
    return F.when(F.contains(text, tag), F.split_part(text, tag, F.lit(2)))


# --- LaTeX normal form ----------------------------------------------------


def unwrap_text(answer: Column) -> Column:
    r"""Content of an answer that is one `\text{...}`."""
    pattern = r"^\\text\{(.+?)\}$"
    return let(
        answer,
        lambda a: F.when(a.rlike(pattern), F.regexp_extract(a, pattern, 1)).otherwise(a),
    )


def _segments(text: Column, command: str) -> Column:
    """The parts of the text that follow each use of a command."""
    return let(
        F.split(text, r"\\" + command),
        lambda parts: F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
    )


def _clean_latex(text: Column) -> Column:
    for old, new in [
        ("\n", ""),
        (r"\!", ""),
        ("\\\\", "\\"),
        ("tfrac", "frac"),
        ("dfrac", "frac"),
        (r"\left", ""),
        (r"\right", ""),
        (r"^{\circ}", ""),
        (r"^\circ", ""),
        (r"\$", ""),
    ]:
        text = swap(text, old, new)
    return text


def _drop_units(text: Column) -> Column:
    text = F.substring_index(text, r"\text{ ", 1)
    for old, new in [(r"\%", ""), (" .", " 0."), ("{.", "{0.")]:
        text = swap(text, old, new)
    return F.regexp_replace(text, r"^\.", "0.")


def _drop_left_side(text: Column) -> Column:
    """`k = 3` reads as `3`."""
    sides = F.split(text, "=")
    short = (F.size(sides) == 2) & (F.length(sides[0]) <= 2)
    return F.when(short, F.try_element_at(sides, F.lit(2))).otherwise(text)


def _brace_roots(text: Column) -> Column:
    return swap(F.regexp_replace(text, r"\\sqrt([^{])", r"\\sqrt{$1}"), " ", "")


def _brace_fractions(text: Column) -> Column:
    """Braced fractions; null when one has no arguments at all."""
    short = F.filter(
        _segments(text, "frac"), lambda s: (s == "") | ((F.length(s) == 1) & (s != "{"))
    )
    braced = F.regexp_replace(text, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    braced = F.regexp_replace(braced, r"\\frac([^{])\{", r"\\frac{$1}{")
    return let(
        F.coalesce(F.try_element_at(short, F.lit(1)), F.lit("none")),
        lambda first: F.when(first == "none", braced).when(first != "", text),
    )


def _simple_fractions(text: Column) -> Column:
    text = F.when(text == "0.5", F.lit("1/2")).otherwise(text)
    return F.regexp_replace(
        text, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{$1}{$2}"
    )


def normalize_latex(answer: Column) -> Column:
    """Normal form used for literal comparison of two LaTeX answers.

    An answer the rules cannot read (two unit parts, a root or fraction without
    arguments) is kept as it came.
    """

    def arguments(text):
        bare_root = F.exists(_segments(text, "sqrt"), lambda s: s == "")
        return F.when(~bare_root, chain(text, _brace_roots, _brace_fractions, _simple_fractions))

    def rules(raw):
        cleaned = _clean_latex(raw)
        readable = F.size(F.split(cleaned, r"\\text\{ ")) <= 2
        normal = chain(
            cleaned,
            _drop_units,
            lambda t: F.when(t == "", t).otherwise(chain(t, _drop_left_side, arguments)),
        )
        return F.coalesce(F.when(readable, normal), raw)

    return let(strip(unwrap_text(strip(answer))), rules)


# --- plain normal form ----------------------------------------------------


def drop_thousands_commas(text: Column) -> Column:
    """Removes commas between digit groups, pass after pass until none is left."""
    pattern = r"([0-9])(,)([0-9][0-9][0-9])($|[^0-9])"

    def passes(t):
        rounds = F.sequence(F.lit(1), F.regexp_count(t, F.lit(",")))
        cleared = F.aggregate(rounds, t, lambda acc, _: F.regexp_replace(acc, pattern, "$1$3$4"))
        return F.when(F.contains(t, F.lit(",")), cleared).otherwise(t)

    return let(text, passes)


def as_number(text: Column) -> Column:
    return let(text, lambda t: F.when(t.rlike(NUMBER), strip(t).try_cast("double")))


def _is_integer(number: Column) -> Column:
    return F.coalesce(F.abs(number - F.round(number, 0)) <= 1e-7, F.lit(False))


def is_integer_text(text: Column) -> Column:
    return let(as_number(drop_thousands_commas(text)), _is_integer)


def _plain_words(text: Column) -> Column:
    for old, new in [
        (r"\%", "%"),
        (r"\$", "$"),
        ("$", ""),
        ("%", ""),
        (" or ", " , "),
        (" and ", " , "),
        *MAGNITUDES,
    ]:
        text = swap(text, old, new)

    def without_units(plain):
        for unit in UNITS:
            plain = F.regexp_replace(plain, unit + r"(es)?(s)? *(\^[0-9]+)?", "")
        return plain

    # Few answers have a unit; one look spares the others a pass for each.
    text = let(text, lambda t: F.when(t.rlike("|".join(UNITS)), without_units(t)).otherwise(t))
    return F.regexp_replace(text, r"\^ *\\circ", "")


def _unbrace(text: Column) -> Column:
    braced = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))
    inner = F.substring(text, F.lit(2), F.length(text) - F.lit(2))
    return F.regexp_replace(F.when(braced, inner).otherwise(text), r",\\! *", "")


# Whole numbers that a double need not hold exactly; they are compared as text.
_LONG_INTEGER = r"^[+-]?[0-9]{16,}$"


def _long_integer(text: Column) -> Column:
    """Sign and digits without leading zeros or a plus; null for any other text."""
    digits = F.regexp_replace(F.regexp_replace(text, r"^\+", ""), "^(-?)0+(?=[0-9])", "$1")
    return F.when(text.rlike(_LONG_INTEGER), digits)


def _round_integers(text: Column) -> Column:
    whole = lambda n: F.coalesce(
        F.round(n, 0).try_cast("decimal(38,0)").cast("string"), text
    )
    return F.coalesce(
        _long_integer(strip(text)),
        let(as_number(text), lambda n: F.when(_is_integer(n), whole(n)).otherwise(text)),
    )


def _squeeze(text: Column) -> Column:
    text = F.regexp_replace(text, "- *", "-")
    text = F.regexp_replace(text, "([0-9]) +([0-9])", "$1+$2")
    for old in (" ", "{", "}"):
        text = swap(text, old, "")
    return F.lower(text)


def _integer_form(text: Column) -> Column:
    def whole(n):
        # Beyond 2^53 a double has no fraction to cut off; floor would stop at 2^63.
        cut = F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("decimal(38,0)")
        return F.when(F.abs(n) < 2.0**53, cut).otherwise(F.round(n, 0).try_cast("decimal(38,0)"))

    plain = swap(text, ",", "")
    value = let(as_number(plain), whole).cast("string")
    return F.coalesce(
        _long_integer(plain), F.when(is_integer_text(text), value), text
    )


def normalize_answer(answer: Column) -> Column:
    """Plain-text normal form: no units, signs, braces, spaces or case."""
    return chain(
        unwrap_text(answer), _plain_words, _unbrace, _round_integers, _squeeze, _integer_form
    )


def split_tuple(text: Column) -> Column:
    """Elements of a bracketed tuple or interval; one element for anything else."""

    def parts(plain):
        inner = F.substring(plain, F.lit(2), F.length(plain) - F.lit(2))
        is_tuple = plain.rlike(r"(?s)^[()\[\]][^()\[\]]+[()\[\]]$")
        return (
            F.when(plain == "", F.array().cast("array<string>"))
            .when(is_tuple, F.transform(F.split(inner, ","), strip))
            .otherwise(F.array(plain))
        )

    return let(drop_thousands_commas(text), parts)


def _read_element(text: Column) -> Column:
    """What the comparison of two elements needs to know about one."""
    return let(
        as_number(drop_thousands_commas(text)),
        lambda number: F.struct(
            text.alias("text"),
            number.alias("number"),
            _is_integer(number).alias("integer"),
            text.rlike(r"^-?[0-9]+.?/0*[1-9][0-9]*.?$").alias("fraction"),
            _long_integer(drop_thousands_commas(text)).alias("long"),
        ),
    )


def _elements_match(a: Column, b: Column) -> Column:
    same_text = a["text"] == b["text"]
    return (
        F.when(a["fraction"] & b["fraction"], same_text)
        .when(a["long"].isNotNull() & b["long"].isNotNull(), a["long"] == b["long"])
        .when(a["integer"] != b["integer"], F.lit(False))
        .otherwise(same_text | F.coalesce(a["number"] == b["number"], F.lit(False)))
    )


def _read_plain(plain: Column) -> Column:
    return F.struct(
        plain.alias("plain"),
        F.concat(F.left(plain, F.lit(1)), F.right(plain, F.lit(1))).alias("brackets"),
        F.transform(split_tuple(plain), _read_element).alias("elements"),
    )


def plain_match(given: Column, truth: Column) -> Column:
    """Equal plain normal forms, or tuples of the same shape with equal elements."""

    def by_element(both):
        g, t = both[0], both[1]
        elements = F.zip_with(t["elements"], g["elements"], _elements_match)
        return (
            (F.length(g["plain"]) > 0)
            & ((F.size(t["elements"]) <= 1) | (g["brackets"] == t["brackets"]))
            & (F.size(t["elements"]) == F.size(g["elements"]))
            & F.forall(elements, lambda e: F.coalesce(e, F.lit(False)))
        )

    def compare(forms):
        read = let(F.transform(forms, _read_plain), by_element)
        return F.coalesce(F.when(forms[0] == forms[1], F.lit(True)).otherwise(read), F.lit(False))

    # One rule for both answers, so the expression holds it once.
    return let(F.transform(F.array(given, truth), normalize_answer), compare)


def answers_match(given: Column, truth: Column) -> Column:
    """True when either normal form agrees; false for a missing answer. Equal answers need no form."""

    def compare(pair):
        latex = let(F.transform(pair, normalize_latex), lambda f: f[0] == f[1])
        return (
            F.when(pair[0] == pair[1], F.lit(True))
            .when(F.coalesce(latex, F.lit(False)), F.lit(True))
            .otherwise(plain_match(pair[0], pair[1]))
        )

    return let(F.array(given, truth), compare)


def reward_value(
    response: Column,
    truths: Column,
    used_tool: Column | None = None,
    ignore_think: bool = False,
    correct: float = 1.0,
    incorrect: float = 0.0,
    format_error: float = 0.0,
    unknown: float = 0.0,
    tool_bonus: float = 0.5,
) -> Column:
    """Reward of one response against any of several truths."""
    usable = F.filter(
        F.transform(
            truths,
            lambda t: F.when(F.contains(t, F.lit(r"\boxed")), boxed_answer(t)).otherwise(t),
        ),
        lambda t: t.isNotNull(),
    )
    bonus = F.lit(0.0) if used_tool is None else F.when(used_tool, tool_bonus).otherwise(0.0)
    row = F.struct(
        boxed_answer(after_think(response, ignore_think)).alias("given"),
        usable.alias("truths"),
        bonus.alias("bonus"),
    )
    return let(
        row,
        lambda r: F.when(r["given"].isNull(), F.lit(format_error))
        .when(r["truths"].isNull() | (F.size(r["truths"]) == 0), F.lit(unknown))
        .when(
            F.exists(r["truths"], lambda t: answers_match(r["given"], t)),
            F.lit(correct) + r["bonus"],
        )
        .otherwise(F.lit(incorrect)),
    )


def unknown_letters(expression: Column) -> Column:
    """Number of distinct letters once root and fraction commands are gone."""
    text = swap(swap(expression, "sqrt", ""), "frac", "")
    letters = F.filter(F.split(text, ""), lambda c: c.rlike(r"^\p{L}$"))
    return F.size(F.array_distinct(letters))


def is_evaluable(answer: Column) -> Column:
    """At most two unknown letters and no power that a solver would choke on."""
    return let(
        normalize_answer(answer),
        lambda text: (unknown_letters(text) <= 2)
        & ~F.contains(text, F.lit("^{"))
        & ~F.contains(text, F.lit("^("))
        & ~text.rlike(r"\^[0-9]+\^")
        & ~text.rlike(r"\^[0-9][0-9]+"),
    )
