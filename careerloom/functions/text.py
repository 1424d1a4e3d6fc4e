"""Text expressions (X1-X13, X20, X21): built-ins only, no Python UDF."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from careerloom.functions import fixed_values as fx


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: What the regex class \s matches.
WHITE_SPACE = " \t\n\x0b\f\r"


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only spaces."""
    return F.trim(_col(c), F.lit(WHITE_SPACE))


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return strip(F.regexp_replace(_col(c), r"\s+", " "))


def has(c: Column | str, pattern: str, ignore_case: bool = True) -> Column:
    """Regex test in which null text is False."""
    return F.coalesce(_col(c).rlike(("(?i)" if ignore_case else "") + pattern), F.lit(False))


def says(c: Column | str, *words: str) -> Column:
    """True when the text contains one of the words, in any case; null text is False.

    For words in lower case the same as ``has`` for a choice of words, in a third of its time.
    """
    lowered = F.lower(_col(c))
    return F.coalesce(reduce(or_, [lowered.contains(w) for w in words]), F.lit(False))


def has_any(c: Column | str, patterns: list[str], ignore_case: bool = True) -> Column:
    """True when one of the patterns is found; one regex, one pass over the text."""
    return has(c, "|".join(f"(?:{p})" for p in patterns), ignore_case)


def starts(c: Column | str, patterns: list[str], ignore_case: bool = True) -> Column:
    """Start-anchored test of a whole alternation."""
    return has(c, "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")", ignore_case)


def remove_in_order(c: Column | str, patterns: list[str], ignore_case: bool = True) -> Column:
    """Delete each pattern in turn."""
    flag = "(?i)" if ignore_case else ""
    return reduce(lambda text, p: F.regexp_replace(text, flag + p, ""), patterns, _col(c))


def year_in(c: Column | str) -> Column:
    """First four-digit group as a year, null when there is none."""
    return F.regexp_substr(_col(c), F.lit(r"\d{4}")).cast("int")


def to_number(c: Column | str, kind: str = "double") -> Column:
    """Tolerant cast: bad text is null."""
    return strip(_col(c)).try_cast(kind)


def whole_year(c: Column | str) -> Column:
    """Text to a whole year; text that is not a number is null."""
    return to_number(c).try_cast("int")


def tokens(c: Column | str) -> Column:
    """White-space tokens; empty array for blank text."""
    return F.filter(F.split(_col(c), r"\s+"), lambda t: t != "")


def tags_in(name: Column | str, tags: list[str]) -> Column:
    """Dictionary words contained in the name, sorted."""
    lowered = F.lower(_col(name))
    found = [F.when(F.coalesce(lowered.contains(t), F.lit(False)), F.lit(t)) for t in sorted(tags)]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def without_tags(name: Column | str, tags: list[str]) -> Column:
    """Lower-cased name with every contained tag removed in sorted order.

    Tags are looked up in the original name, so a tag that only appears once
    an earlier one is gone stays.  Replacing the empty text changes nothing,
    which keeps this one flat chain of replacements.
    """
    lowered = F.lower(_col(name))
    text = lowered
    for tag in sorted(tags):
        text = F.replace(text, F.when(lowered.contains(tag), F.lit(tag)).otherwise(F.lit("")), F.lit(""))
    return F.coalesce(squeeze(text), F.lit(""))


def normalised_name(c: Column | str) -> Column:
    """Company name as its meaningful tokens, null when none is left.

    After the first step only letters, digits and single spaces are left, so
    whole tokens can be dropped by word boundary.
    """
    text = F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9]+", " ")
    words = "|".join(t for t in fx.DROP_TOKENS if t.isalnum())
    kept = F.regexp_replace(text, rf"\b(?:{words})\b", "")
    return F.nullif(F.trim(F.regexp_replace(kept, " +", " ")), F.lit(""))


def longest(a: Column | str, b: Column | str) -> Column:
    return F.greatest(F.length(_col(a)), F.length(_col(b)))


def similarity(a: Column | str, b: Column | str) -> Column:
    """100 * (1 - edit distance / longer length); two empty texts are 100 (X11)."""
    distance = F.levenshtein(_col(a), _col(b))
    return F.when(longest(a, b) == 0, F.lit(100.0)).otherwise(
        (F.lit(1.0) - distance / longest(a, b)) * F.lit(100.0)
    )


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Distance of the lower-cased texts, null when either is null."""
    return F.levenshtein(F.lower(_col(a)), F.lower(_col(b)))


def probability_label(p: Column | str) -> Column:
    """Five ordered labels from a probability; null stays null."""
    value = _col(p)
    branch = F.when(value.isNull(), F.lit(None).cast("string"))
    for cut, label in zip(fx.LABEL_CUTS, fx.LABEL_ORDER):
        branch = branch.when(value >= cut, F.lit(label))
    return branch.otherwise(F.lit(fx.LABEL_ORDER[-1]))


def sorted_parts(c: Column | str) -> Column:
    """Distinct '; '-separated parts in order."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(_col(c), "; "))), "; ")


def canonical_url(c: Column | str, host: str = "linkedin.com") -> Column:
    """Lower-case, no query or fragment, no sub-domain of ``host``, one trailing slash cut.

    Plain string functions: this runs on every row, and a regex per step costs
    several times as much.  A URL with no sub-domain keeps its scheme.
    """
    sub = F.lit("." + host)
    text = F.substring_index(F.substring_index(F.lower(strip(c)), "?", 1), "#", 1)
    text = F.when(text.contains(sub), F.concat(F.lit(host), F.substring_index(text, "." + host, -1))).otherwise(text)
    return F.when(text.endswith("/"), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
