"""Text rules against plain Python statements of them."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from careerloom.functions import fixed_values as fx
from careerloom.functions import text as tx
from conftest import rows

TAGS = ["college", "state", "university", "community"]
ALPHABET = st.text("aeiostuvnrycl mg&.,-/ ", max_size=24)


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(ALPHABET, st.lists(st.sampled_from([*TAGS, "of", "ohio", "x"])).map(" ".join)), min_size=30, max_size=60))
def test_tags_and_clean_name(spark, names):
    def clean(name):
        low, out = name.lower(), name.lower()
        for tag in sorted(t for t in TAGS if t in low):
            out = out.replace(tag, "").strip()
        return " ".join(out.split())

    assert column(spark, names, tx.without_tags("s", TAGS)) == [clean(n) for n in names]
    assert column(spark, names, tx.tags_in("s", TAGS)) == [sorted(t for t in TAGS if t in n.lower()) for n in names]


def test_null_name_has_no_tags(spark):
    assert column(spark, [None], tx.without_tags("s", TAGS)) == [""]
    assert column(spark, [None], tx.tags_in("s", TAGS)) == [[]]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["The", "of", "Acme", "co", "INC.", "&", "a-b", "x1", " ", ",", "Ltd"])).map(" ".join), min_size=30, max_size=60))
def test_normalised_name(spark, names):
    def norm(name):
        text = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in name.lower())
        return " ".join(t for t in text.split() if t not in fx.DROP_TOKENS) or None

    assert column(spark, names, tx.normalised_name("s")) == [norm(n) for n in names]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("a,b", [("", ""), ("abc", ""), ("kitten", "sitting"), ("x", "x"), ("Ohio", "ohio")])
def test_similarity(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    want = 100.0 if not a and not b else (1 - distance(a, b) / max(len(a), len(b))) * 100
    got = df.select(tx.similarity("a", "b"), tx.edit_distance("a", "b")).first()
    assert got[0] == pytest.approx(want) and got[1] == distance(a.lower(), b.lower())


def test_edit_distance_of_null(spark):
    assert rows(spark.createDataFrame([(None, "b")], "a string, b string").select(tx.edit_distance("a", "b"))) == [(None,)]


def test_years_and_numbers(spark):
    values = ["2001", "March 2001", "abc", "", None, "12 345 67890", " 1999 "]
    assert column(spark, values, tx.year_in("s")) == [2001, 2001, None, None, None, 6789, 1999]
    assert column(spark, ["1999", " 1999 ", "n/a", "", None, "1e3"], tx.whole_year("s")) == [1999, 1999, None, None, None, 1000]


def test_white_space_is_trimmed(spark):
    assert column(spark, ["\t a  b \n", None], tx.squeeze("s")) == ["a b", None]
    assert column(spark, ["  a\tb  c ", " ", None], tx.tokens("s")) == [["a", "b", "c"], [], None]


def test_canonical_url(spark):
    urls = [
        " HTTPS://uk.linkedin.com/company/A/?trk=1#x ", "https://linkedin.com/company/b/", "http://www.linkedin.com/c",
        "linkedin.com/d#e?f", "https://a.linkedin.com.b.linkedin.com/g", "https://other.org/h//", None,
    ]
    assert column(spark, urls, tx.canonical_url("s")) == [
        "linkedin.com/company/a", "https://linkedin.com/company/b", "linkedin.com/c", "linkedin.com/d", "linkedin.com/g",
        "https://other.org/h/", None,
    ]


def test_probability_labels(spark):
    df = spark.createDataFrame([(p,) for p in (0.8, 0.79, 0.65, 0.35, 0.2, 0.19, None)], "p double")
    got = [r[0] for r in df.coalesce(1).select(tx.probability_label("p")).collect()]
    assert got == ["highly likely", "likely", "likely", "unclear", "unlikely", "highly unlikely", None]


def test_sorted_parts(spark):
    assert column(spark, ["b; a; b"], tx.sorted_parts("s")) == ["a; b"]


def test_start_anchor_covers_the_whole_alternation(spark):
    assert column(spark, ["xb", "b", "a", None], tx.starts("s", ["a", "b"])) == [False, True, True, False]
    assert column(spark, [None], F.expr("s") .isNull()) == [True]


def test_says_is_has_for_a_choice_of_words(spark):
    values = [None, "", "CO-FOUNDER", "coowner", "Homeowner", "Entrepreneur", "ceo", "engİneer", "own er", "FOUNDKER"]
    old = tx.has("s", fx.BROAD_FOUNDER)
    assert column(spark, values, tx.says("s", "entrepreneur", "founder", "owner")) == column(spark, values, old)
    assert column(spark, [None, "March 1999", "19", "x20015y2002"], tx.year_in("s")) == [None, 1999, None, 2001]
