"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Values are found by pattern and validated: card numbers by their check digit, also where other numbers stand one blank
or hyphen away, dates by the calendar, addresses and telephone and social security numbers by their ranges. A keyed Feistel network permutes the values of one format among
themselves, so a pseudonym is valid in the same format and equal values have equal pseudonyms in every document. The
local part of a mail address goes through a Feistel network of characters; its domain stays. Invalid look-alikes stay.

Null text stays null and empty text empty, with no values found. Repeated rows give repeated results. Extra columns
are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Formats in the order in which they are looked for at a place of the text.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "address": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![./-]?[0-9])",
    "phone": r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+",
}
#: A run of digit groups ends where a value of another format begins; possessive, so that long runs need no stack.
_BEGINS = "|".join((
    PATTERNS["address"], PATTERNS["date"].replace("[0-9]{4}-", "(?:1[89]|2[01])[0-9]{2}-"),
    r"[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])", PATTERNS["ssn"],
))
_RUN = PATTERNS["card"].replace("(?:[ -]?", f"(?:(?![ -](?:{_BEGINS}))[ -]?")
ANY = "|".join(f"(?:{p})" for p in [*PATTERNS.values()][:-1] + [_RUN])
#: Cards as they are usually printed; these are looked for first in a run that holds more than a card.
USUAL = r"^(?:[2-6][0-9]{12,18}|[2-6][0-9]{3}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{3}([ -])[0-9]{6}\2[0-9]{4,5})$"
LEAST_DIGITS, MOST_DIGITS = 13, 19
#: 400 years of days, the calendar's full cycle, from this day on.
FIRST_DAY, DAYS_LEFT, DAYS_RIGHT = "1800-01-01", 189, 773


def _noise(key: str, kind: str, turn: Column, half: Column) -> Column:
    """Round function: 60 bits of a keyed digest."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(value: Column, left: Column, right: Column, key: str, kind: str) -> Column:
    """Permutes the numbers from 0 up to ``left`` times ``right``."""

    def turn(s: Column, i: Column) -> Column:
        l, r = s["l"], s["r"]
        return F.when(
            i % 2 == 0, F.struct(F.pmod(l + _noise(key, kind, i, r), left).alias("l"), r.alias("r"))
        ).otherwise(F.struct(l.alias("l"), F.pmod(r + _noise(key, kind, i, l), right).alias("r")))

    start = F.struct(F.floor(value / right).cast("long").alias("l"), F.pmod(value, right).alias("r"))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * right + s["r"])
    return out


def _number(text: Column) -> Column:
    return text.try_cast("long")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _laid_out(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits``, in order."""
    step = lambda s, i: F.when(
        F.substring(shape, i, F.lit(1)).rlike("[0-9]"),
        F.struct(F.concat(s["out"], F.substring(digits, s["n"] + 1, F.lit(1))).alias("out"), (s["n"] + 1).alias("n")),
    ).otherwise(F.struct(F.concat(s["out"], F.substring(shape, i, F.lit(1))).alias("out"), s["n"].alias("n")))
    return F.aggregate(F.sequence(F.lit(1), F.length(shape)), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step, lambda s: s["out"])


def _check_sum(digits: Column) -> Column:
    """Sum of the digits where, from the right, every second one counts double (less 9 above 9)."""

    def step(s: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).try_cast("int")
        return s + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    n = F.length(d) - 1
    low = F.floor(n / 2)
    right, left = F.pow(F.lit(10.0), low).cast("long"), F.pow(F.lit(10.0), n - low).cast("long")
    paid = F.lpad(feistel(_number(F.substring(d, F.lit(1), n)), left, right, key, "card").cast("string"), 19, "0")
    paid = F.substring(paid, 20 - n, n)
    check = F.pmod(10 - F.pmod(_check_sum(F.concat(paid, F.lit("0"))), F.lit(10)), F.lit(10))
    return F.when(F.pmod(_check_sum(d), F.lit(10)) == 0, _laid_out(m, F.concat(paid, check.cast("string"))))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value written and computed once."""
    return F.transform(F.array(value), use)[0]


def _cards(run: Column, key: str) -> Column:
    """(kinds, made) of a run of digit groups: the whole if it is a valid card, else the valid cards at group borders.

    Usual forms are taken first, then any other part of the run, each from the left and the longest at a place.
    """
    most = 2 * MOST_DIGITS - 1
    part = lambda at, n: F.substring(run, at, n)
    valid = lambda m: (
        F.length(_digits(m)).between(LEAST_DIGITS, MOST_DIGITS) & (F.pmod(_check_sum(_digits(m)), F.lit(10)) == 0)
    )
    places = F.filter(F.sequence(F.lit(1), F.length(run)), lambda i: (i == 1) | part(i - 1, F.lit(1)).isin(" ", "-"))

    def longest(at: Column, usual: bool) -> Column:
        ends = lambda n: (at + n == F.length(run) + 1) | part(at + n, F.lit(1)).isin(" ", "-")
        good = lambda n: (at + n <= F.length(run) + 1) & ends(n) & ~part(at + n - 1, F.lit(1)).isin(" ", "-")
        fits = lambda n: good(n) & (part(at, n).rlike(USUAL) if usual else F.lit(True)) & valid(part(at, n))
        return F.coalesce(F.get(F.filter(F.sequence(F.lit(most), F.lit(LEAST_DIGITS), F.lit(-1)), fits), F.lit(0)), F.lit(0))

    def taken(usual: bool, before: Column | None) -> Column:
        """(at, n) of the cards from the left, clear of those in ``before``."""
        spots = F.filter(F.transform(places, lambda at: F.struct(at.cast("int").alias("at"), longest(at, usual).cast("int").alias("n"))), lambda s: s["n"] > 0)
        if before is not None:
            spots = F.filter(spots, lambda s: ~F.exists(before, lambda b: (s["at"] < b["at"] + b["n"]) & (b["at"] < s["at"] + s["n"])))
        step = lambda out, s: F.when(
            s["at"] >= out["free"], F.struct((s["at"] + s["n"]).alias("free"), F.concat(out["all"], F.array(s)).alias("all"))
        ).otherwise(out)
        start = F.struct(F.lit(1).alias("free"), F.array().cast("array<struct<at:int,n:int>>").alias("all"))
        return F.aggregate(spots, start, step, lambda out: out["all"])

    def written(cards: Column) -> Column:
        step = lambda out, c: F.struct(
            (c["at"] + c["n"]).alias("next"), F.concat(out["text"], part(out["next"], c["at"] - out["next"]), _card(part(c["at"], c["n"]), key)).alias("text")
        )
        made = F.aggregate(
            cards, F.struct(F.lit(1).alias("next"), F.lit("").alias("text")), step,
            lambda out: F.concat(out["text"], part(out["next"], F.length(run))),
        )
        return F.struct(F.transform(cards, lambda _: F.lit("card")).alias("kinds"), made.alias("made"))

    whole = F.array(F.struct(F.lit(1).alias("at"), F.length(run).cast("int").alias("n")))
    some = _bound(taken(True, None), lambda first: F.array_sort(F.concat(first, taken(False, first))))
    return _bound(F.when(valid(run), whole).otherwise(some), written)


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    ten = F.substring(d, F.length(d) - 9, F.lit(10))
    area, office, line = (_number(F.substring(ten, a, b)) for a, b in ((1, 3), (4, 3), (7, 4)))
    new = feistel(((area - 200) * 800 + office - 200) * 10000 + line, F.lit(80000), F.lit(80000), key, "phone")
    made = F.concat(
        F.substring(d, F.lit(1), F.length(d) - 10), (F.floor(new / 8000000) + 200).cast("string"),
        (F.pmod(F.floor(new / 10000), F.lit(800)) + 200).cast("string"), F.lpad(F.pmod(new, F.lit(10000)).cast("string"), 4, "0"),
    )
    return F.when((area >= 200) & (office >= 200), _laid_out(m, made))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (_number(F.substring(m, a, b)) for a, b in ((1, 3), (5, 2), (8, 4)))
    place = area - 1 - (area > 666).cast("long")  # 1 to 899 without 666
    new = feistel((place * 99 + group - 1) * 9999 + serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")
    at = F.floor(new / (99 * 9999)) + 1
    made = F.concat_ws(
        "-", F.lpad((at + (at > 665).cast("long")).cast("string"), 3, "0"), F.lpad((F.pmod(F.floor(new / 9999), F.lit(99)) + 1).cast("string"), 2, "0"),
        F.lpad((F.pmod(new, F.lit(9999)) + 1).cast("string"), 4, "0"),
    )
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), made)


def _address(m: Column, key: str) -> Column:
    parts = [_number(F.substring_index(F.substring_index(m, ".", i), ".", -1)) for i in range(1, 5)]
    new = feistel(reduce(lambda a, b: a * 256 + b, parts), F.lit(65536), F.lit(65536), key, "address")
    made = F.concat_ws(".", *[F.pmod(F.floor(new / 256**i), F.lit(256)).cast("string") for i in (3, 2, 1, 0)])
    plain = F.concat_ws(".", *[p.cast("string") for p in parts]) == m
    return F.when(plain & reduce(lambda a, b: a & b, [p <= 255 for p in parts]), made)


def _date(m: Column, key: str) -> Column:
    """Dates with the year first, or last after day and month in either order.

    With slashes the month comes first and with dots the day, unless only the other order is a date. The pseudonym has
    the order that was read; parts read with two digits have two, parts read with one have no leading zero.
    """
    parts = F.split(m, "[-./]")
    size = lambda i: F.length(parts[i])
    read = lambda y, mo, d: F.concat_ws("-", parts[y], F.lpad(parts[mo], 2, "0"), F.lpad(parts[d], 2, "0")).try_cast("date")
    iso = size(0) == 4
    month_leads = F.when(F.contains(m, F.lit("/")), read(2, 0, 1).isNotNull()).otherwise(read(2, 1, 0).isNull())
    day = F.when(iso, read(0, 1, 2)).when(month_leads, read(2, 0, 1)).otherwise(read(2, 1, 0))
    place = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    new = feistel(place, F.lit(DAYS_LEFT), F.lit(DAYS_RIGHT), key, "date")

    def back(made: Column) -> Column:
        year, month, dom = (F.date_format(made, f) for f in ("yyyy", "M", "d"))
        wide = lambda x, i: F.when(size(i) == 2, F.lpad(x, 2, "0")).otherwise(x)
        sep = F.regexp_extract(m, "[-./]", 0)
        return (
            F.when(iso, F.concat_ws("-", year, wide(month, 1), wide(dom, 2)))
            .when(month_leads, F.concat(wide(month, 0), sep, wide(dom, 1), sep, year))
            .otherwise(F.concat(wide(dom, 0), sep, wide(month, 1), sep, year))
        )

    made = _bound(F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), back)
    return F.when(place.between(0, DAYS_LEFT * DAYS_RIGHT - 1), made)


def _shifted(part: Column, other: Column, key: str, turn: int) -> Column:
    """Letters and digits of ``part`` moved within their kind by a keyed digest of ``other``."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lit(str(turn)), other).cast("binary"), 256)

    def step(out: Column, i: Column) -> Column:
        c = F.substring(part, i, F.lit(1))
        by = F.conv(F.substring(digest, F.pmod(i - 1, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        move = lambda first, n: F.char(F.pmod(F.ascii(c) - first + by, F.lit(n)) + first)
        return F.concat(out, F.when(c.rlike("[a-z]"), move(97, 26)).when(c.rlike("[A-Z]"), move(65, 26)).when(c.rlike("[0-9]"), move(48, 10)).otherwise(c))

    return F.when(F.length(part) == 0, part).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(part))), F.lit(""), step))


def _email(m: Column, key: str) -> Column:
    name = F.substring_index(m, "@", 1)
    half = F.floor(F.length(name) / 2).cast("int")
    start = F.array(F.substring(name, F.lit(1), half), F.substring(name, half + 1, F.length(name)))
    out = start
    for turn in range(4):  # a step per round through a lambda, so that each round is written once
        out = F.transform(
            F.array(out),
            (lambda t: lambda s: F.array(_shifted(s[0], s[1], key, t), s[1]) if t % 2 == 0 else F.array(s[0], _shifted(s[1], s[0], key, t)))(turn),
        )[0]
    return F.concat(F.array_join(out, ""), F.lit("@"), F.substring_index(m, "@", -1))


_MAKERS = {"email": _email, "address": _address, "date": _date, "phone": _phone, "ssn": _ssn}


def pseudonym(value: Column, key: str) -> Column:
    """(kinds, made) of one found value; both null if it is not valid in any format. A run of digit groups may hold many cards."""

    def named(kind: str) -> Column:
        return _bound(_MAKERS[kind](value, key), lambda x: F.when(x.isNotNull(), F.struct(F.array(F.lit(kind)).alias("kinds"), x.alias("made"))))

    out = F.when(value.rlike(f"^(?:{PATTERNS['card']})$"), _cards(value, key))
    for kind in reversed(_MAKERS):
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), named(kind)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, n_found, kinds, text) of every row of ``docs`` (doc_id, text): values replaced, and how many of each kind."""
    found = docs.select("doc_id", "text", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("_values"))
    some = F.coalesce(F.size("_values"), F.lit(0)) > 0
    made = F.transform("_values", lambda v: F.struct(v.alias("value"), pseudonym(v, key).alias("p")))
    named = found.withColumn("_made", F.when(some, made))
    pieces = F.split(F.col("text"), ANY, -1)
    joined = F.aggregate(
        F.sequence(F.lit(1), F.size("_values")), pieces[0],
        lambda out, i: F.concat(out, F.coalesce(F.element_at("_made", i)["p"]["made"], F.element_at("_made", i)["value"]), F.element_at(pieces, i + 1)),
    )
    kinds = F.flatten(F.filter(F.transform("_made", lambda x: x["p"]["kinds"]), lambda k: k.isNotNull()))
    out = named.select("doc_id", F.when(some, joined).otherwise(F.col("text")).alias("text"), F.coalesce(kinds, F.array().cast("array<string>")).alias("kinds"))
    return out.select("doc_id", F.size("kinds").cast("long").alias("n_found"), "kinds", "text")
