"""Personal data under format-preserving pseudonyms (operator 3), in Spark functions only.

Found are card numbers (valid by their check digit), telephone numbers, IPv4 addresses with
octets up to 255, IPv6 addresses, dates that exist, social security and account numbers (valid by
their rules), e-mail addresses, also with letters beyond ASCII, and credentials: access keys, bearer
tokens, and what a name such as `password` or `secret_key` is set to, if it has eight letters and
digits or, with a digit or sign among them, four characters. Each is replaced by another value of the same
format: a keyed Feistel network permutes its characters within their kinds, so equal values
get equal pseudonyms in all documents and different values different ones.

* Characters: the two halves of the value's letters and digits are shifted in turns by numbers
  from a keyed hash of the other half; a digit stays a digit, a letter a letter of its case.
  Punctuation stays in place. Check digits are made anew.
* IPv4 addresses: octets in two halves, each among the octets of as many digits.
* Dates: the day within its own cycle of 400 years, written as 189 times 773, whose two digits
  are shifted in turns; the result is a date that exists, in the same notation. Where a part has one
  digit, or the month stands first, the network goes on until the result can be written so.
* Social security numbers: the first two parts and the last one among the valid ones.

Numbers that fail their check pass untouched. An account or card number is looked for at every
place where one can begin, in every length that it can have there: one with the length of its
country or else the longest that is valid. So what stands before or behind a number never hides it.
Lengths never change. A null text stays null, an empty one empty; other columns, names and
repeated rows stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.answers import let

ROUNDS = 8

# Kinds in the order they are tried at a place. Possessive parts keep long words linear.
_EDGE, _END = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
EMAIL = (
    r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@(?:[\p{L}\p{N}\-]{1,63}\.){1,8}[A-Za-z]{2,24}"
    + r"(?![\p{L}\p{N}])"
)
# What a credential is called, and the sign before it.
_NAMED = r"(?i:passw(?:or)?d|passphrase|pwd|token|secret(?:_access)?(?:_key)?|(?:access|private)_key|api_?key)\s{0,3}[=:]\s{0,3}[\"']?"
_BEARER = r"(?i:bearer)\s{1,3}"
SECRET = (
    r"(?<![A-Za-z0-9])(?:AKIA[A-Z2-7]{16}" + _END
    # With a digit or a sign; what ends the sentence around it stays outside.
    + "|" + _NAMED + r"(?:(?=[^\s\"',;<>]{0,127}[0-9@#$%^*])[^\s\"',;<>]{3,2047}[^\s\"',;<>.:!?()\[\]{}]"
    + r"|[A-Za-z0-9]{8,128}+" + _END + ")"
    + "|" + _BEARER + r"(?=[^\s]{0,15}[0-9])[A-Za-z0-9._~+/\-]{16,2048}+={0,2})"
)
_IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END
# Lengths of account numbers by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
DATE = (
    r"(?<![A-Za-z0-9.\-/])(?:[0-9]{4}([\-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([\-/.])[0-9]{1,2}\2[0-9]{4})"
    r"(?![A-Za-z0-9]|[.\-/][0-9])"
)
IPV4 = (
    r"(?<![A-Za-z0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![A-Za-z0-9]|\.[0-9])"
)
_HEX = "[0-9A-Fa-f]{1,4}"
IPV6 = (
    rf"(?<![A-Za-z0-9:.])(?=[A-Fa-f:]{{0,39}}[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}})"
    r"(?![A-Za-z0-9:]|\.[0-9])"
)
SSN = r"(?<![A-Za-z0-9\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![A-Za-z0-9]|-[0-9])"
# The separators' references are numbered with the number as a group.
_CARD = (
    r"(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\2[0-9]{4}\2[0-9]{4}(?:\2[0-9]{3})?"
    r"|[0-9]{4}([ \-])[0-9]{6}\3[0-9]{5})" + _END
)
PHONE = (
    r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}" + _END
    + r"|(?<![A-Za-z0-9+])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}" + _END
)
# The longest that can begin at each place where one can.
IBANS, CARDS = (f"{_EDGE}(?=({p}))" for p in (_IBAN, _CARD))
# One pattern, around a row's own account and card numbers: references to separators are
# numbered in the whole.
_BEFORE, _BEHIND = "|".join(f"(?:{p})" for p in (EMAIL, SECRET)), "|".join(f"(?:{p})" for p in (DATE, IPV4, IPV6, SSN, PHONE))
# Every text that anything is found in matches this.
CAN_HOLD = r"[0-9@]|AKIA|" + _NAMED
NO_HIT = "no_hit"


def _digest(key: str, round_: Column, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(key + "|"), round_.cast("string"), F.lit("|"), value), 256)


def _number(digest: Column, at: Column | int, length: int) -> Column:
    """Hex digits of a digest as a number."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substr(digest, at, F.lit(length)), 16, 10).cast("long")


def _shifted(char: Column, by: Column, digits: tuple[int, int], letters: int) -> Column:
    """A character moved within its kind; `digits` has first code and count, `letters` a count."""
    code = F.ascii(char)
    first, many = digits

    def move(base: int, size: int) -> Column:
        return F.char((F.pmod(code - base + by, F.lit(size)) + base).cast("long"))

    return (
        F.when(char.rlike("^[0-9]$"), move(first, many))
        .when(char.rlike("^[a-z]$"), move(97, letters))
        .when(char.rlike("^[A-Z]$"), move(65, letters))
        .otherwise(char)
    )


def permuted(value: Column, key: str, digits: tuple[int, int] = (48, 10), letters: int = 26) -> Column:
    """The value's letters and digits under a keyed Feistel network of their two halves."""
    plain = F.regexp_replace(value, "[^A-Za-z0-9]", "")
    cut = F.floor(F.length(plain) / 2).cast("int")
    start = F.struct(
        F.substr(plain, F.lit(1), cut).alias("moved"), F.substr(plain, cut + 1).alias("other")
    )

    def turn(acc: Column, round_: Column) -> Column:
        shift = F.transform(
            F.array(_digest(key, round_, acc["other"])),
            lambda d: F.array_join(
                F.transform(
                    F.filter(F.split(acc["moved"], ""), lambda c: c != ""),
                    # Four hex digits per character; longer halves take them in a circle.
                    lambda c, i: _shifted(c, _number(d, (i % 16) * 4 + 1, 4), digits, letters),
                ),
                "",
            ),
        )[0]
        return F.struct(acc["other"].alias("moved"), shift.alias("other"))

    done = F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda a: F.concat(a["moved"], a["other"])
    )
    return F.transform(F.array(done), lambda d: _poured(value, d))[0]


def _poured(value: Column, plain: Column) -> Column:
    """The characters of `plain` in place of the value's letters and digits, one for one."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    filled = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.when(
            c.rlike("^[A-Za-z0-9]$"),
            F.struct(
                F.concat(acc["out"], F.substr(plain, acc["at"], F.lit(1))).alias("out"),
                (acc["at"] + 1).alias("at"),
            ),
        ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))),
        lambda acc: acc["out"],
    )
    return filled


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column, odd: int) -> Column:
    """Luhn's sum; digits at places of the parity `odd`, from the right, are doubled."""
    return F.aggregate(
        F.transform(
            F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
            lambda c, i: F.when(
                i % 2 == odd, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10
            ).otherwise(c.cast("int")).cast("int"),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )


def iban_rest(value: Column) -> Column:
    """The account number modulo 97, its first four characters moved to the end."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    return F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise(
            (a * 100 + F.ascii(c) - 55) % 97
        ).cast("int"),
    )


def _ibans(text: Column) -> Column:
    """Valid account numbers, one at most for each place where one can begin."""

    def valid(run: Column) -> Column:
        def longest(parts: Column) -> Column:
            cuts = F.transform(
                F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), " ")
            )
            # Twelve characters are the fewest that the pattern takes.
            right = F.filter(cuts, lambda c: (F.length(F.replace(c, F.lit(" "))) >= 12) & (iban_rest(c) == 1))
            return let(right, lambda r: F.coalesce(F.get(F.filter(r, _registered), F.lit(0)), F.get(r, F.lit(0))))

        return let(F.split(run, " "), longest)

    return F.transform(F.regexp_extract_all(text, F.lit(IBANS), F.lit(1)), valid)


def _registered(value: Column) -> Column:
    country, length = F.substr(value, F.lit(1), F.lit(2)), F.length(F.replace(value, F.lit(" ")))
    known = F.lit(False)
    for n, countries in IBAN_LENGTHS.items():
        known = known | ((length == n) & country.isin(countries.split()))
    return known


def _is_card(plain: Column) -> Column:
    return F.length(plain).between(13, 19) & ~plain.rlike("^0+$") & (luhn_sum(plain, 1) % 10 == 0)


def _cards(text: Column) -> Column:
    """Valid card numbers, one at most for each place where one can begin."""

    def valid(run: Column) -> Column:
        # Sixteen digits in fours can have three more behind them.
        short = F.when(F.length(run) - F.length(_digits(run)) == 4, F.substr(run, F.lit(1), F.lit(19)))
        return F.when(_is_card(_digits(run)), run).when(_is_card(_digits(short)), short)

    return F.transform(F.regexp_extract_all(text, F.lit(CARDS), F.lit(1)), valid)


def _found(text: Column) -> Column:
    """The pattern of all that can be personal in the text, with the numbers that are valid in it."""
    # A longer number goes before its own beginning. Letters, digits, blanks and hyphens need no escape.
    numbers = F.array_sort(
        F.array_distinct(F.filter(F.concat(_ibans(text), _cards(text)), lambda v: v.isNotNull())),
        lambda a, b: F.length(b) - F.length(a),
    )
    return let(
        F.when(text.rlike("[0-9]{4}"), numbers).otherwise(F.array().cast("array<string>")),
        lambda own: F.when(
            F.size(own) > 0,
            F.concat(F.lit(f"{_BEFORE}|{_EDGE}(?=[A-Z0-9]{{2}}[0-9]{{2}})(?:"), F.array_join(own, "|"),
                     F.lit(f"){_END}|{_BEHIND}")),
        ).otherwise(F.lit(f"{_BEFORE}|{_BEHIND}")),
    )


def _card(value: Column, key: str) -> Column:
    """The first digit stays, the middle is permuted, the check digit is made anew."""
    plain = _digits(value)
    middle = permuted(F.substr(plain, F.lit(2), F.length(plain) - 2), key + "card")
    body = F.concat(F.substr(plain, F.lit(1), F.lit(1)), middle)
    checked = F.transform(
        F.array(body),
        lambda b: F.concat(b, F.pmod(10 - luhn_sum(b, 0) % 10, F.lit(10)).cast("string")),
    )[0]
    return F.transform(F.array(checked), lambda c: _poured(value, c))[0]


def _iban(value: Column, key: str) -> Column:
    """The country stays, the account is permuted, the check digits are made anew."""
    plain = F.regexp_replace(value, " ", "")
    country = F.substr(plain, F.lit(1), F.lit(2))
    account = permuted(F.substr(plain, F.lit(5)), key + "iban")
    made = F.transform(
        F.array(account),
        lambda a: F.concat(
            country,
            F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), a))).cast("string"), 2, "0"),
            a,
        ),
    )[0]
    return F.transform(F.array(made), lambda m: _poured(value, m))[0]


def _ipv4(value: Column, key: str) -> Column:
    parts = F.split(value, r"\.")
    start = F.struct(F.slice(parts, 1, 2).alias("moved"), F.slice(parts, 3, 2).alias("other"))

    def shifted(octet: Column, by: Column) -> Column:
        # Octets of one, two and three digits are permuted among themselves.
        first = F.when(F.length(octet) == 1, 0).when(F.length(octet) == 2, 10).otherwise(100)
        many = F.when(F.length(octet) == 1, 10).when(F.length(octet) == 2, 90).otherwise(156)
        return (F.pmod(octet.cast("long") - first + by, many) + first).cast("string")

    def turn(acc: Column, r: Column) -> Column:
        digest = F.array(_digest(key + "ipv4", r, F.array_join(acc["other"], ".")))
        new = F.transform(
            digest,
            lambda d: F.transform(acc["moved"], lambda o, i: shifted(o, _number(d, i * 4 + 1, 4))),
        )[0]
        return F.struct(acc["other"].alias("moved"), new.alias("other"))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn,
        lambda a: F.array_join(F.concat(a["moved"], a["other"]), "."),
    )


def _product(high: Column, low: Column, a: int, b: int, key: str) -> Column:
    """A pair below (`a`, `b`) under a keyed Feistel network: struct of `high` and `low`."""
    start = F.struct(high.cast("long").alias("high"), low.cast("long").alias("low"))

    def turn(acc: Column, r: Column) -> Column:
        by_low = _number(_digest(key, r * 2, acc["low"].cast("string")), 1, 8)
        moved = F.pmod(acc["high"] + by_low, F.lit(a))
        return let(moved, lambda h: F.struct(
            h.alias("high"),
            F.pmod(acc["low"] + _number(_digest(key, r * 2 + 1, h.cast("string")), 1, 8), F.lit(b)).alias("low"),
        ))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1)), start, turn)


def _ssn(value: Column, key: str) -> Column:
    """Another valid number: areas 001 to 899 but 666, groups from 01, serials from 0001."""
    part = [F.substr(value, F.lit(at), F.lit(n)).cast("long") for at, n in ((1, 3), (5, 2), (8, 4))]
    area = part[0] - 1 - (part[0] > 666).cast("long")
    moved = _product(area * 99 + part[1] - 1, part[2] - 1, 898 * 99, 9999, key + "ssn")

    def written(m: Column) -> Column:
        first = F.floor(m["high"] / 99) + 1
        return F.concat_ws("-", *[
            F.lpad(n.cast("long").cast("string"), width, "0")
            for n, width in ((first + (first > 665).cast("long"), 3), (m["high"] % 99 + 1, 2), (m["low"] + 1, 4))
        ])

    return let(moved, written)


# Days of the Gregorian cycle of 400 years, as a product; the day that cycles begin on, and the
# day and number of cycles of all years of four digits: those that no cycle holds whole make one.
CYCLE = (189, 773)
CYCLE_START = "1800-01-01"
FIRST_DAY, CYCLES = "0000-01-01", 25
# Steps after which a date stays as it is. Of all dates one in nine or more can be written with parts of
# one digit, so a walk this long has a chance below 10^-50.
WALK = 1024


def _date_parts(value: Column) -> tuple[Column, Column]:
    """Parts of a date as written, and the notation: year first, day first or month first."""
    parts = F.split(value, r"[\-/.]")
    year_first = F.length(F.element_at(parts, 1)) == 4

    def made(y: int, m: int, d: int) -> Column:
        return F.try_to_date(
            F.concat_ws("-", F.element_at(parts, y), F.lpad(F.element_at(parts, m), 2, "0"),
                        F.lpad(F.element_at(parts, d), 2, "0")), "yyyy-MM-dd")

    notation = (
        F.when(year_first & made(1, 2, 3).isNotNull(), "ymd")
        .when(~year_first & made(3, 2, 1).isNotNull(), "dmy")
        .when(~year_first & made(3, 1, 2).isNotNull(), "mdy")
    )
    day = F.when(notation == "ymd", made(1, 2, 3)).when(notation == "dmy", made(3, 2, 1)).otherwise(
        made(3, 1, 2)
    )
    return day, notation


def _date(value: Column, key: str) -> Column:
    day, notation = _date_parts(value)
    a, b = CYCLE
    first, days = F.lit(FIRST_DAY).cast("date"), a * b * CYCLES
    begin = F.datediff(F.lit(CYCLE_START).cast("date"), first)

    def moved(d: Column) -> Column:
        """The day permuted within its cycle."""
        number = F.pmod(F.datediff(d, first) - begin, F.lit(days)).cast("long")
        in_cycle = number % (a * b)
        new = _product(F.floor(in_cycle / b), in_cycle % b, a, b, key + "date")
        return let(new, lambda m: F.date_add(
            first, F.pmod(number - in_cycle + m["high"] * b + m["low"] + begin, F.lit(days)).cast("int")))

    parts = F.split(value, r"[\-/.]")
    year_first = notation == "ymd"
    month = F.length(F.when(notation == "mdy", F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(1))))
    of_month = F.length(F.when(year_first, F.get(parts, F.lit(2))).when(
        notation == "dmy", F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(1))))

    def fits(d: Column) -> Column:
        """Parts of one digit stay so, and a day that told the notation still does."""
        return (
            ((month == 2) | (F.month(d) < 10)) & ((of_month == 2) | (F.dayofmonth(d) < 10))
            & ((notation != "mdy") | (F.dayofmonth(d) > 12))
        )

    # Going on from a day of the set along the permutation's cycle comes back to the set.
    state = F.struct(moved(day).alias("day"), F.lit(1).alias("steps"))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.when(fits(moved(day)), 1).otherwise(WALK)), state,
        lambda acc, _: F.when(fits(acc["day"]), acc).otherwise(
            F.struct(moved(acc["day"]).alias("day"), (acc["steps"] + 1).alias("steps"))),
        lambda acc: F.when(fits(acc["day"]), acc["day"]).otherwise(day),
    )
    mark = F.regexp_extract(value, r"[\-/.]", 0)

    def written(d: Column) -> Column:
        y = F.lpad(F.year(d).cast("string"), 4, "0")
        m, n = F.lpad(F.month(d).cast("string"), month, "0"), F.lpad(F.dayofmonth(d).cast("string"), of_month, "0")
        return F.when(year_first, F.concat(y, mark, m, mark, n)).when(
            notation == "dmy", F.concat(n, mark, m, mark, y)).otherwise(F.concat(m, mark, n, mark, y))

    return let(walked, written)


def _email(value: Column, key: str) -> Column:
    """The name before the sign and the first label after it are permuted."""
    name = F.regexp_extract(value, "^[^@]*", 0)
    label = F.regexp_extract(value, r"@([^.]*)", 1)
    rest = F.regexp_extract(value, r"@[^.]*(.*)$", 1)
    return F.concat(permuted(name, key + "name"), F.lit("@"), permuted(label, key + "host"), rest)


def _secret(value: Column, key: str) -> Column:
    """What follows the sign, or the whole access key after its first four letters."""
    head = F.regexp_extract(value, rf"^(?:AKIA|{_NAMED}|{_BEARER})", 0)
    tail = F.substr(value, F.length(head) + 1)
    return F.concat(
        head,
        F.when(head == "AKIA", permuted(tail, key + "access", digits=(50, 6)))
        .when(tail.rlike("^[0-9a-f]+$"), permuted(tail, key + "hex", letters=6))
        .otherwise(permuted(tail, key + "secret")),
    )


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def kind_of(value: Column) -> Column:
    """The kind of a found value, `no_hit` if it fails its check."""
    plain = _digits(value)
    return (
        F.when(value.rlike(_whole(SECRET)), "secret")
        .when(value.contains("@"), "email")
        .when(value.rlike(_whole(IPV6)), "ipv6")
        .when(value.rlike("^[A-Z]{2}"), F.when(iban_rest(value) == 1, "iban").otherwise(NO_HIT))
        .when(value.rlike(_whole(DATE)), F.when(_date_parts(value)[0].isNotNull(), "date").otherwise(NO_HIT))
        .when(value.rlike(_whole(IPV4)), "ipv4")
        .when(value.rlike(_whole(SSN)), "ssn")
        .when(value.rlike(_whole(PHONE)), "phone")
        .when(_is_card(plain), "card")
        .otherwise(NO_HIT)
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """Another value of the same kind and format; what fails its check stays as it is."""
    return (
        F.when(kind == "email", _email(value, key))
        .when(kind == "secret", _secret(value, key))
        .when(kind == "iban", _iban(value, key))
        .when(kind == "date", _date(value, key))
        .when(kind == "ipv4", _ipv4(value, key))
        .when(kind == "ipv6", permuted(value, key + "ipv6", letters=6))
        .when(kind == "ssn", _ssn(value, key))
        .when(kind == "phone", _phone(value, key))
        .when(kind == "card", _card(value, key))
        .otherwise(value)
    )


def _phone(value: Column, key: str) -> Column:
    """The country code stays."""
    head = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .\-])", 0)
    return F.concat(head, permuted(F.substr(value, F.length(head) + 1), key + "phone"))


def pseudonymized(text: Column, key: str) -> Column:
    """The text with every personal value replaced."""

    def replaced(found: Column) -> Column:
        pieces = F.split(text, found, -1)
        hits = F.regexp_extract_all(text, found, F.lit(0))
        kinds = F.transform(hits, lambda h: F.struct(h.alias("h"), kind_of(h).alias("k")))
        new = F.transform(kinds, lambda x: pseudonym(x["h"], x["k"], key))
        # One piece more than hits: the last one has nothing behind it.
        return F.array_join(F.zip_with(pieces, new, lambda p, h: F.concat(p, F.coalesce(h, F.lit("")))), "")

    return F.when(text.rlike(CAN_HOLD), let(_found(text), replaced)).otherwise(text)


def pseudonymize(docs: DataFrame, key: str = "pseudonyms", text_column: str = "text") -> DataFrame:
    """The documents with personal values under pseudonyms; all columns stay in place."""
    return docs.select(
        *[
            (pseudonymized(F.col(f"`{c}`"), key).alias(c) if c == text_column else F.col(f"`{c}`"))
            for c in docs.columns
        ]
    )


def personal_values(text: Column) -> Column:
    """Kinds of the personal values of a text, in text order."""
    kinds = let(
        _found(text),
        lambda found: F.filter(
            F.transform(F.regexp_extract_all(text, found, F.lit(0)), kind_of), lambda k: k != NO_HIT
        ),
    )
    none = F.array().cast("array<string>")
    return F.when(text.rlike(CAN_HOLD), kinds).otherwise(none)
