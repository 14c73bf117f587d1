"""PII pseudonyms by keyed Feistel permutations within a value's format, in DataFrame operations only.

Validated numbers and dates are permuted among the values of their format, so they stay valid and equal values stay
linked across documents. A value's number is split in two parts that take turns: each is shifted, modulo its range, by a
keyed hash of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "ip", "date", "ssn", "phone", "card")

# The patterns of candidates, of which one is tried after the other.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)",
    "date": r"(?<![\w/-])(?:\d{4}-\d{2}-\d{2}(?=T\d{2}:\d{2})|(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\w/-]))",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w(])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?!\w)",
    "card": r"(?<![\w-])(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\w-])",
}
# A value stands alone when its kind is told: what must follow a date isn't part of it.
WHOLE = {kind: f"^(?:{p[p.index(')') + 1 :] if p.startswith('(?<!') else p})$" for kind, p in PATTERNS.items()} | {"date": r"^(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})$"}
#: Candidates other than e-mail addresses begin with a digit, a plus or a bracket.
NUMBERS = r"(?=[0-9+(])(?:" + "|".join(p for k, p in PATTERNS.items() if k != "email") + ")"
ANY = f"{PATTERNS['email']}|{NUMBERS}"
#: Days from 1900-01-01 that dates are permuted among (to 2099-12-31), and two ranges whose product is a little more.
DAYS, DAY_RANGES = 73_049, (271, 270)


def let(value: Column, use) -> Column:
    """use(value), with the value computed once and standing once in the plan."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keyed(key: str, kind: str, turn: Column, part: Column, limits: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), limits, part.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def permuted(x: Column, y: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """The pair (x, y) permuted among all pairs of numbers below a and below b."""
    limits = F.concat_ws("x", a.cast("string"), b.cast("string"))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        moved = F.pmod(F.when(even, s["x"]).otherwise(s["y"]) + keyed(key, kind, i, F.when(even, s["y"]).otherwise(s["x"]), limits), F.when(even, a).otherwise(b))
        return F.struct(F.when(even, moved).otherwise(s["x"]).alias("x"), F.when(even, s["y"]).otherwise(moved).alias("y"))

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), turn)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refilled(text: Column, digits: Column) -> Column:
    """The text with its digits replaced one by one."""
    place = lambda i: F.substring(text, i, F.lit(1))
    seen = lambda i: F.length(digits_of(F.substring(text, F.lit(1), i)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.when(place(i).rlike("[0-9]"), F.substring(digits, seen(i), F.lit(1))).otherwise(place(i))), "")


def luhn(digits: Column, last_doubled: bool) -> Column:
    """Sum of the digits where every second one, the last included or not, counts by the digits of its double."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n + 1 - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == (1 if last_doubled else 0), twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def padded(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n if isinstance(n, Column) else F.lit(n), F.lit("0"))


def card(value: Column, key: str) -> Column:
    def of(digits: Column) -> Column:
        n = F.length(digits) - 1
        left = F.floor(n / 2).cast("int")
        pair = permuted(F.substring(digits, F.lit(1), left).cast("long"), F.substring(digits, left + 1, n - left).cast("long"), power(left), power(n - left), key, "card")
        body = let(pair, lambda p: F.concat(padded(p["x"], left), padded(p["y"], n - left)))
        return let(body, lambda b: F.concat(b, F.pmod(-luhn(b, True), F.lit(10)).cast("string")))

    return let(let(digits_of(value), of), lambda digits: refilled(value, digits))


def phone(value: Column, key: str) -> Column:
    """A country code stays; the ten digits after it are permuted."""

    def of(digits: Column) -> Column:
        part = lambda i: F.substring(digits, F.length(digits) - i, F.lit(5)).cast("long")
        pair = permuted(part(9), part(4), F.lit(100_000), F.lit(100_000), key, "phone")
        return let(pair, lambda p: F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), padded(p["x"], 5), padded(p["y"], 5)))

    return let(let(digits_of(value), of), lambda digits: refilled(value, digits))


def ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substring(value, i, n).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    pair = permuted(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    back = lambda x: F.when(x >= 665, x + 2).otherwise(x + 1)
    return let(pair, lambda p: F.concat_ws("-", padded(back(p["x"]), 3), padded(F.floor(p["y"] / 9999) + 1, 2), padded(p["y"] % 9999 + 1, 4)))


def ip(value: Column, key: str) -> Column:
    part = lambda i: F.element_at(F.split(value, r"\."), i).cast("long")
    pair = permuted(part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536), key, "ip")
    return let(pair, lambda p: F.concat_ws(".", *(x.cast("string") for n in ("x", "y") for x in (F.floor(p[n] / 256), p[n] % 256))))


def day_first(value: Column) -> Column:
    return F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2)).try_cast("date")


def day_of(value: Column) -> Column:
    """Days since 1900-01-01 of a date in any format (with slashes day first, or else month first), null if there is none."""
    month_first = F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 1, 2), F.substring(value, 4, 2)).try_cast("date")
    own = F.when(value.contains("/"), F.coalesce(day_first(value), month_first)).otherwise(value.try_cast("date"))
    return F.date_diff(own, F.lit("1900-01-01").cast("date"))


def date(value: Column, key: str) -> Column:
    a, b = map(F.lit, DAY_RANGES)
    step = lambda d: let(permuted(F.floor(d / b), d % b, a, b, key, "date"), lambda p: p["x"] * b + p["y"])
    # Days beyond the range are permuted again until they fall into it.
    walk = lambda first: F.aggregate(F.sequence(F.lit(1), F.lit(24)), first + DAYS, lambda d, i: F.when((i > 1) & (d < DAYS), d).otherwise(step(F.when(i == 1, d - DAYS).otherwise(d))))
    walked = let(day_of(value).cast("long"), walk)
    day = F.date_add(F.lit("1900-01-01").cast("date"), walked.cast("int"))
    return let(day, lambda d: F.when(value.contains("/"), F.when(day_first(value).isNotNull(), F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))).otherwise(F.date_format(d, "yyyy-MM-dd")))


def email(value: Column, key: str) -> Column:
    """The part before @ as a keyed name; the domain stays."""
    at = F.substring_index(value, "@", 1)
    return F.concat(F.lit("user"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)), 256), 1, 12), F.substring(value, F.length(at) + 1, F.length(value)))


def valid(kind: str, value: Column) -> Column:
    digits = digits_of(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: x.cast("int") <= 255)
    if kind == "date":
        return F.coalesce(day_of(value).between(0, DAYS - 1), F.lit(False))
    if kind == "ssn":
        area = F.substring(value, 1, 3)
        return ~area.isin("000", "666") & (area < "900") & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000")
    if kind == "card":
        return (luhn(digits, False) % 10 == 0) & digits.rlike("[1-9]")
    return F.lit(True)


MAKERS = {"email": email, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}


def pseudonymised(docs: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """The documents with their columns, the text's personal data replaced, and n_<kind>: how many of each kind were.

    Card numbers must pass the check digit (and pass it afterwards), dates and addresses must exist, social security
    numbers must be assignable, phone numbers are told by their North American format; other numbers and IPv6 addresses
    stay. Dates move among 1900 to 2099. A null text stays null and has no counts but 0. Columns of the input named like a
    count are replaced, all others stay. Equal values get equal pseudonyms under one key; repeated rows give a row each.
    """
    text = F.col(text_col)
    named, numbered = text.contains("@"), text.rlike("[0-9][0-9/.) -]*[0-9]")

    def by_kind(make) -> Column:
        """With the pattern that a text needs: that of e-mail addresses only where there can be one."""
        return F.when(named, make(ANY)).when(numbered, make(NUMBERS))

    values = F.coalesce(by_kind(lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))), F.array().cast("array<string>"))

    def found(value: Column) -> Column:
        kind = F.coalesce(*(F.when(value.rlike(WHOLE[k]) & valid(k, value), F.lit(k)) for k in KINDS))
        return F.struct(value.alias("value"), kind.alias("kind"))

    def replaced(x: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for k, make in MAKERS.items():
            out = out.when(x["kind"] == k, make(x["value"], key))
        return out.otherwise(x["value"])

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    marked = docs.select(row.alias("row"), F.transform(values, found).alias("found"), text.alias("text"), by_kind(lambda p: F.split(text, p, -1)).alias("pieces"))
    whole = F.array_join(F.flatten(F.zip_with("pieces", F.transform("found", replaced), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    out = F.when(F.exists("found", lambda x: x["kind"].isNotNull()), whole).otherwise(F.col("text"))
    number = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    counts = {f"n_{k}": number(k) for k in KINDS}
    kept = [out.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in counts]
    return marked.select(*kept, *(n.alias(c) for c, n in counts.items()))
