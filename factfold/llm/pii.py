"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Each value found in a text is validated (Luhn for cards, octets for addresses, the calendar for dates, mod 97 for IBANs, issued
ranges for social security and North American phone numbers) and replaced by a keyed permutation of its format: a Feistel network
over two halves whose round function is SHA-256 of key, kind, round and the other half. A permutation keeps different values apart,
and equal values get equal pseudonyms in all documents without any table or shuffle. Values that fail validation stay.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold.llm.common import free_name, read

#: The session's setting that holds the key, and what op10 takes where it is unset: good for the synthetic tables only.
SETTING, DEMONSTRATION_KEY, ROUNDS = "spark.factfold.pii.key", "factfold demonstration key", 8
#: What is looked for, in this order where two could start at the same character.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[Pp]assword|[Tt]oken|[Ss]ecret|[Aa]pi_key) ?[=:] ?[\"']?[A-Za-z0-9][A-Za-z0-9_+/~-]{6,}[A-Za-z0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?<!\b[Vv])(?<!\b[Vv]ersion )(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/])(?:[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{4}/[0-9]{2}/[0-9]{2})(?![0-9/])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9-])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9]|-[0-9])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Dates that are permuted: months and days from the first of them up to the end of 2099.
_FIRST, _MONTHS, _DAYS = "1900-01-01", 2_400, 73_049
#: The sizes of the two halves for days of the month up to 12 (exactly all of them) and beyond (one more than there are).
_LOW, _HIGH = (160, 180), (250, 177)


def _digest(key: str, kind: str, r: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(f"{key}|{kind}"), r.cast("string"), half.cast("string")), 256)


def numbers(key: str, kind: str, a: Column, size_a: Column, b: Column, size_b: Column) -> Column:
    """Feistel permutation of the pairs (a, b) below (size_a, size_b): struct(a, b)."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    f = lambda r, half: F.conv(F.substr(_digest(key, kind, r, half), F.lit(1), F.lit(15)), 16, 10).cast("long")
    step = lambda s, r: F.struct(
        F.when(r % 2 == 1, F.pmod(s["a"] + F.pmod(f(r, s["b"]), size_a), size_a)).otherwise(s["a"]).cast("long").alias("a"),
        F.when(r % 2 == 0, F.pmod(s["b"] + F.pmod(f(r, s["a"]), size_b), size_b)).otherwise(s["b"]).cast("long").alias("b"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _shifted(text: Column, digest: Column) -> Column:
    """Each letter or digit moved within its own class by a byte of the digest."""

    def move(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(digest, (i % 32 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        classes = [("[0-9]", 48, 10), ("[a-z]", 97, 26), ("[A-Z]", 65, 26)]
        return F.coalesce(*(F.when(c.rlike(p), F.char((F.ascii(c) - base + by) % n + base)) for p, base, n in classes), c)

    return F.concat_ws("", F.transform(F.split(text, ""), move))


def letters(key: str, kind: str, text: Column) -> Column:
    """Feistel permutation of the texts of one pattern of digits, small and capital letters; other characters stay."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1, F.length(text)).alias("b"))
    step = lambda s, r: F.struct(
        F.when(r % 2 == 1, _shifted(s["a"], _digest(key, kind, r, s["b"]))).otherwise(s["a"]).alias("a"),
        F.when(r % 2 == 0, _shifted(s["b"], _digest(key, kind, r, s["a"]))).otherwise(s["b"]).alias("b"),
    )
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return F.concat(done["a"], done["b"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(like: Column, digits: Column) -> Column:
    """The digits in the places that ``like`` has digits; the counts are equal."""
    place = lambda i: F.length(_digits(F.substr(like, F.lit(1), i)))
    put = lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, place((i + 1).cast("int")), F.lit(1))).otherwise(c)
    return F.concat_ws("", F.transform(F.split(like, ""), put))


def _padded(n: Column, width: Column) -> Column:
    return F.lpad(n.cast("string"), width, F.lit("0"))


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """Sum of the Luhn terms of digits; every second one from the right is doubled, from the last one on if so told."""
    term = lambda c, i: F.when(i % 2 == (0 if double_last else 1), (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), term), F.lit(0), lambda a, x: a + x)


def _card(key: str, m: Column) -> Column:
    """The first digit names the network and stays; the last is the check digit of the new number."""
    d = _digits(m)
    inner = F.substr(d, F.lit(2), F.length(d) - 2)
    half = F.floor(F.length(inner) / 2).cast("int")
    rest = F.length(inner) - half
    size = lambda w: F.pow(F.lit(10.0), w).cast("long")
    ab = numbers(key, "card", F.substr(inner, F.lit(1), half), size(half), F.substr(inner, half + 1, rest), size(rest))
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), _padded(ab["a"], half), _padded(ab["b"], rest))
    check = F.pmod(F.lit(10) - F.pmod(luhn_sum(body, True), F.lit(10)), F.lit(10))
    return F.when(F.pmod(luhn_sum(d, False), F.lit(10)) == 0, _refill(m, F.concat(body, check.cast("string"))))


def _ip(key: str, m: Column) -> Column:
    o = F.split(m, r"\.")
    n = [o[i].cast("int") for i in range(4)]
    ab = numbers(key, "ip", n[0] * 256 + n[1], F.lit(65536), n[2] * 256 + n[3], F.lit(65536))
    part = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), F.pmod(x, F.lit(256)).cast("string"))
    return F.when(F.greatest(*n) < 256, F.concat_ws(".", part(ab["a"]), part(ab["b"])))


def _bound(value: Column, f) -> Column:
    """f(value), the value being computed once."""
    return F.transform(F.array(value), f)[0]


def moved_date(key: str, day: Column) -> Column:
    """A permutation of the dates of 1900 to 2099 that keeps days of the month up to 12 there and others beyond.

    So whatever can be read as one notation only stays so, and a date has the same pseudonym in all notations.
    """
    first = F.lit(_FIRST).cast("date")
    month = (F.year(day) - 1900) * 12 + F.month(day) - 1
    start = lambda m: F.add_months(first, m.cast("int"))
    beyond = lambda m: F.datediff(start(m), first) - m * 12  # days beyond the 12th of all earlier months

    def turned(x: Column, kind: str, sizes: tuple[int, int]) -> Column:
        ab = numbers(key, kind, F.floor(x / sizes[1]), F.lit(sizes[0]), F.pmod(x, F.lit(sizes[1])), F.lit(sizes[1]))
        return ab["a"] * sizes[1] + ab["b"]

    low = _bound(turned(month * 12 + F.dayofmonth(day) - 1, "date12", _LOW), lambda x: F.date_add(start(F.floor(x / 12)), F.pmod(x, F.lit(12)).cast("int")))
    last = _HIGH[0] * _HIGH[1] - 1  # stands for no date; what is moved there is moved on, and that can't lead there again
    rank = F.datediff(day, first) - (month + 1) * 12

    def dated(x: Column) -> Column:
        near = F.floor(x * _MONTHS / last)
        m = F.array_max(F.filter(F.transform(F.array(near - 1, near, near + 1), lambda m: F.greatest(F.lit(0), F.least(F.lit(_MONTHS - 1), m))), lambda m: beyond(m) <= x))
        return _bound(m, lambda m: F.date_add(start(m), (x - beyond(m) + 12).cast("int")))

    high = _bound(turned(rank, "date31", _HIGH), lambda x: _bound(F.when(x == last, turned(x, "date31", _HIGH)).otherwise(x), dated))
    return F.when(F.dayofmonth(day) <= 12, low).otherwise(high)


def _date(key: str, m: Column) -> Column:
    """Dates of 1900 to 2099; of day/month and month/day the first that the calendar allows. Others stay."""
    forms = [(r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{4}/", "yyyy/MM/dd"), (r"^\d\d/", "dd/MM/yyyy"), (r"^\d\d/", "MM/dd/yyyy")]
    first, parsed = F.lit(_FIRST).cast("date"), [F.when(m.rlike(p), F.try_to_timestamp(m, F.lit(form)).cast("date")) for p, form in forms]
    fit = lambda d: d.isNotNull() & F.datediff(d, first).between(0, _DAYS - 1)
    shown = lambda d: F.coalesce(*(F.when(fit(p), F.date_format(d, form)) for p, (_, form) in zip(parsed, forms, strict=True)))
    return _bound(F.coalesce(*(F.when(fit(p), p) for p in parsed)), lambda d: F.when(d.isNotNull(), _bound(moved_date(key, d), shown)))


def _ssn(key: str, m: Column) -> Column:
    """Areas 001 to 899 but 666, groups from 01 and serials from 0001 are permuted among themselves; other numbers stay."""
    d = _digits(m)
    area, group, serial = F.substr(d, F.lit(1), F.lit(3)).cast("int"), F.substr(d, F.lit(4), F.lit(2)).cast("int"), F.substr(d, F.lit(6), F.lit(4)).cast("int")
    ab = numbers(key, "ssn", (area - 1 - (area > 666).cast("int")) * 99 + group - 1, F.lit(898 * 99), serial - 1, F.lit(9_999))

    def put(x: Column) -> Column:
        new = F.floor(x["a"] / 99) + 1
        return _refill(m, F.concat(_padded(new + (new >= 666).cast("int"), F.lit(3)), _padded(F.pmod(x["a"], F.lit(99)) + 1, F.lit(2)), _padded(x["b"] + 1, F.lit(4))))

    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), _bound(ab, put))


def _phone(key: str, m: Column) -> Column:
    """The country code stays; area and exchange codes from 200 on stay there. Without a country code both must be from 200 on."""
    d = _digits(m)
    area, rest = F.substr(d, F.length(d) - 9, F.lit(3)).cast("int"), F.substr(d, F.length(d) - 6, F.lit(7)).cast("long")
    split = lambda x, one: (F.when(x >= 200 * one, F.lit(200 * one)).otherwise(0), F.when(x >= 200 * one, F.lit(800 * one)).otherwise(200 * one))
    (base, size), (low, width) = split(area, 1), split(rest, 10_000)
    ab = numbers(key, "phone", area - base, size, rest - low, width)
    new = _bound(ab, lambda x: _refill(m, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), _padded(x["a"] + base, F.lit(3)), _padded(x["b"] + low, F.lit(7)))))
    return F.when(m.startswith("+") | ((area >= 200) & (rest >= 2_000_000)), new)


def _mod97(text: Column) -> Column:
    """The remainder of an IBAN, already turned round, with letters as two-digit numbers."""
    step = lambda a, c: F.pmod(F.when(c.rlike("[0-9]"), a * 10 + (F.ascii(c) - 48)).otherwise(a * 100 + (F.ascii(c) - 55)), F.lit(97))
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(key: str, spaced: Column) -> Column:
    m = F.replace(spaced, F.lit(" "), F.lit(""))
    country, account = F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(5), F.length(m))
    new = letters(key, "iban", account)
    check = F.lit(98) - _mod97(F.concat(new, country, F.lit("00")))
    made = F.concat(country, _padded(check, F.lit(2)), new)
    fit = (F.length(m) >= 15) & (_mod97(F.concat(account, F.substr(m, F.lit(1), F.lit(4)))) == 1)
    return F.when(fit, F.when(spaced.contains(" "), F.regexp_replace(made, "(.{4})(?=.)", "$1 ")).otherwise(made))


def _email(key: str, m: Column) -> Column:
    """The last label of the domain stays."""
    domain, top = F.substring_index(m, "@", -1), F.substring_index(m, ".", -1)
    return F.concat(letters(key, "email", F.substring_index(m, "@", 1)), F.lit("@"), letters(key, "domain", F.substr(domain, F.lit(1), F.length(domain) - F.length(top) - 1)), F.lit("."), top)


def _secret(key: str, m: Column) -> Column:
    name = F.regexp_extract(m, "^([A-Za-z_]+ ?[=:] ?[\"']?)", 1)
    return F.concat(name, letters(key, "secret", F.substr(m, F.length(name) + 1, F.length(m))))


def pseudonym(key: str, m: Column) -> Column:
    """struct(kind, value) of one match; the kind is null if it isn't valid."""
    makers = {
        "email": lambda x: _email(key, x),
        "key": lambda x: F.concat(F.lit("AKIA"), letters(key, "key", F.substr(x, F.lit(5), F.lit(16)))),
        "secret": lambda x: _secret(key, x), "iban": lambda x: _iban(key, x), "ip": lambda x: _ip(key, x), "date": lambda x: _date(key, x),
        "ssn": lambda x: _ssn(key, x), "phone": lambda x: _phone(key, x), "card": lambda x: _card(key, x),
    }
    value, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(KINDS):
        is_kind = m.rlike("^(?:" + _bare(KINDS[name]) + ")$")
        value, kind = F.when(is_kind, makers[name](m)).otherwise(value), F.when(is_kind, F.lit(name)).otherwise(kind)
    return F.struct(value.alias("value"), kind.alias("kind"))


def _bare(pattern: str) -> str:
    """The pattern without what it asks of the characters around it."""
    return re.sub(r"\(\?<?![^()]*\)", "", pattern)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with the values in text replaced, and two columns more: pii_kinds (of each value replaced, in order) and pii_count.

    Whoever has the key can undo the permutations, so it belongs into the session's settings and not into code.

    Null texts stay null with no values; texts without a value stay as they are. Rows are treated one by one, so repeated
    rows stay repeated and an empty table gives an empty result. Columns of docs by the two new names are replaced.
    """
    found = F.when(F.col("text").rlike("[0-9@=:]|AKIA"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    values, made = free_name(docs, "values"), free_name(docs, "made")
    new = F.transform(values, lambda m: pseudonym(key, m))
    joined = F.concat_ws("", F.transform(F.split("text", ANY, -1), lambda g, i: F.concat(g, F.coalesce(F.get(F.col(made)["value"], i), F.get(F.col(values), i), F.lit("")))))
    kinds = F.filter(F.transform(made, lambda x: F.when(x["value"].isNotNull(), x["kind"])), lambda k: k.isNotNull())
    rows = docs.withColumn(values, F.coalesce(found, F.array().cast("array<string>"))).withColumn(made, new)
    text = F.when(F.size(values) > 0, joined).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("pii_kinds", kinds).withColumn("pii_count", F.size("pii_kinds").cast("long")).drop(values, made)


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(SETTING, DEMONSTRATION_KEY))
