"""Columns over program text, test cases and program output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.answers import strip

TESTS_SCHEMA = "struct<inputs:array<string>,outputs:array<string>>"


def last_code_block(response: Column) -> Column:
    """Stripped text of the last fenced block; null when there is none."""
    blocks = F.regexp_extract_all(response, F.lit(r"(?s)```(?:\w+)?\n(.*?)```"), F.lit(1))
    return strip(F.try_element_at(blocks, F.lit(-1)))


def strip_main_block(code: Column) -> Column:
    """Program without its main guards and the indented or blank lines below them.

    The text is cut at the guards; each part after one starts at its first line
    that is neither blank nor indented.
    """
    guard = r"""\n[^\S\n]*if __name__ == (?:"__main__"|'__main__')[^\n]*"""
    outdented = r"\n(?![ \t])(?=[^\n]*\S)"
    parts = F.split(F.concat(F.lit("\n"), code), guard)

    def rest(part):
        at = F.regexp_instr(part, F.lit(outdented))
        return F.when(at > 0, F.substring(part, at, F.length(part))).otherwise(F.lit(""))

    kept = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(rest(p)))
    joined = F.array_join(kept, "")
    return F.substring(joined, F.lit(2), F.length(joined))


def lines_without_prefix(code: Column, prefix: str) -> Column:
    """Lines whose stripped form does not start with the prefix."""
    return F.array_join(
        F.filter(F.split(code, "\n"), lambda x: ~F.startswith(strip(x), F.lit(prefix))), "\n"
    )


def lines_with_prefix(code: Column, prefix: str) -> Column:
    return F.array_join(
        F.filter(F.split(code, "\n"), lambda x: F.startswith(strip(x), F.lit(prefix))), "\n"
    )


def parse_tests(text: Column) -> Column:
    """Typed tests from JSON text; null when the text is not that JSON."""
    parsed = F.from_json(text, TESTS_SCHEMA)
    return F.when(parsed["inputs"].isNotNull() & parsed["outputs"].isNotNull(), parsed)


def tests_to_pairs(tests: Column) -> Column:
    """`{inputs, outputs}` as a list of `{input, output}`."""
    return F.zip_with(
        tests["inputs"], tests["outputs"],
        lambda i, o: F.struct(i.alias("input"), o.alias("output")),
    )


def pairs_to_tests(pairs: Column) -> Column:
    """A list of `{input, output}` as `{inputs, outputs}`."""
    return F.struct(
        F.transform(pairs, lambda p: p["input"]).alias("inputs"),
        F.transform(pairs, lambda p: p["output"]).alias("outputs"),
    )


def longest_tests(pairs: Column, limit: int) -> Column:
    """The tests with the longest input, first come first among equals.

    A list within the limit keeps its order.
    """
    keyed = F.transform(
        pairs, lambda p, i: F.struct((-F.length(p["input"])).alias("k"), i.alias("i"), p.alias("p"))
    )
    chosen = F.transform(F.slice(F.array_sort(keyed), 1, limit), lambda s: s["p"])
    return F.when(F.size(pairs) > limit, chosen).otherwise(pairs)


_DECIMAL = r"^([+-]?)(?=[.]?[0-9])([0-9]*)[.]?([0-9]*)(?:[eE]([+-]?[0-9]{1,9}))?$"


def decimal_form(word: Column) -> Column:
    """A number of any length as sign, digits without outer zeros, and exponent; else null.

    Two words have the same form exactly when they are the same decimal number.
    """
    part = lambda i: F.regexp_extract(word, _DECIMAL, i)
    digits = F.regexp_replace(F.concat(part(2), part(3)), "^0+", "")
    kept = F.regexp_replace(digits, "0+$", "")
    exponent = (
        F.coalesce(part(4).try_cast("int"), F.lit(0)) - F.length(part(3)) + F.length(digits) - F.length(kept)
    )
    sign = F.when(part(1) == "-", "-").otherwise("")
    form = F.when(kept == "", "0").otherwise(F.concat(sign, kept, F.lit("e"), exponent.cast("string")))
    return F.when(word.rlike(_DECIMAL), form)


def output_matches(output: Column, expected: Column) -> Column:
    """Same number of lines, each equal as text or number by number."""
    lines = lambda t: F.transform(F.split(strip(t), "\n"), strip)

    def numbers(line):
        return F.transform(F.split(line, r"\s+"), decimal_form)

    def same_line(a, b):
        na, nb = numbers(a), numbers(b)
        numeric = F.forall(na, lambda v: v.isNotNull()) & F.forall(nb, lambda v: v.isNotNull())
        return (a == b) | (numeric & (na == nb))

    left, right = lines(output), lines(expected)
    pairs = F.zip_with(left, right, same_line)
    return (F.size(left) == F.size(right)) & F.forall(
        pairs, lambda p: F.coalesce(p, F.lit(False))
    )
