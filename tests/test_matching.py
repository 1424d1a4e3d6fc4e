"""Blocked fuzzy matching against brute force, and the feed against the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from careerloom.operators import matching
from careerloom.sources.readers import universities as unique_universities
from careerloom.streaming.url_feed import accepted_rows, decided_urls, run_url_feed
from conftest import rows
from test_text import distance

WORDS = ["ohio", "texas", "north", "georgia", "tech", "arts", "valley", "saint", "mary", "lake"]
KINDS = ["university of", "state university", "college", "community college", ""]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)

    def name():
        return f"{rng.choice(KINDS)} {' '.join(rng.sample(WORDS, rng.randrange(1, 4)))}".strip()

    def typo(text):
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(text) + 1)
            text = text[:i] + rng.choice(["", "x", "e"]) + text[i + rng.randrange(0, 2):]
        return text

    unis = sorted({name() for _ in range(60)})
    uni = spark.createDataFrame([(i, n) for i, n in enumerate(unis)], "unitid long, instnm string")
    titles = [(typo(rng.choice(unis)) if rng.random() < 0.7 else name(), f"u{rng.randrange(50)}") for _ in range(200)]
    titles += [(None, "u1"), ("", "u2"), ("college", "u3")]
    return uni, unis, spark.createDataFrame(titles, "title string, school_url string"), titles


def clean(name, tags):
    low = (name or "").lower()
    found, out = sorted(t for t in tags if t in low), low
    for t in found:
        out = out.replace(t, "").strip()
    return ",".join(found), " ".join(out.split())


def brute(unis, titles, tags, cutoff, per):
    best = {}
    for title, url in titles:
        block, name = clean(title, tags)
        for unit, inst in enumerate(unis):
            other_block, other = clean(inst, tags)
            longest = max(len(name), len(other))
            score = 100.0 if longest == 0 else (1 - distance(name, other) / longest) * 100
            if block == other_block and score >= cutoff:
                key = name if per == "clean_name" else url
                rank = (-score, unit, url, (title is not None, title or ""))
                if key not in best or rank < best[key][0]:
                    best[key] = (rank, (key, unit, url, round(score, 6)))
    return sorted(v[1] for v in best.values())


@pytest.mark.parametrize("per", ["clean_name", "school_url"])
@pytest.mark.parametrize("cutoff", [40, 70, 85, 100])
def test_fuzzy_match_is_brute_force(tables, per, cutoff):
    uni, unis, titles, raw = tables
    tags = matching.tag_list(uni)
    got = matching.fuzzy_match(uni, titles, tags, cutoff, per)
    key = "clean_name" if per == "clean_name" else "school_url"
    assert rows(got.select(F.col(key).alias("k"), "unitid", "school_url", F.round("lev_score", 6))) == sorted(
        brute(unis, raw, tags, cutoff, per), key=repr
    )


def test_empty_and_missing_inputs(spark, tables):
    uni, _, titles, _ = tables
    assert matching.fuzzy_match(None, titles, [], 70) is None
    assert matching.fuzzy_match(uni, titles.limit(0), ["college"], 70).count() == 0
    with pytest.raises(ValueError):
        matching.fuzzy_match(uni, titles, [], 0)


def test_tag_dictionary_counts_words_not_names(spark):
    uni = spark.createDataFrame([(1, "State State Arts"), (2, "Arts of Iowa"), (3, "Iowa the")], "unitid long, instnm string")
    assert [tuple(r) for r in matching.tag_dictionary(uni, 2).collect()] == [("arts", 2), ("iowa", 2)]
    assert matching.tag_dictionary(uni).count() == 3


def test_repeated_institution_names_are_all_dropped(spark):
    uni = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "unitid long, instnm string")
    assert rows(unique_universities(uni).select("unitid")) == [(2,)]


def education(spark, tables):
    _, _, _, raw = tables
    data = [
        (i, i % 90, t, "BA", None, None, "1991", "1995", None if i % 17 == 0 else u)
        for i, (t, u) in enumerate(raw)
    ]
    return spark.createDataFrame(data, (
        "id long, member_id long, title string, subtitle string, activities_and_societies string, description string, "
        "date_from string, date_to string, school_url string"))


def test_education_match_keeps_every_row_of_a_matched_url(spark, tables):
    uni = tables[0]
    tags, edu = matching.tag_list(uni), education(spark, tables)
    urls = {r[0] for r in matching.school_matches(matching.matchable(edu), uni, tags, per="school_url").select("school_url").collect()}
    got = matching.match_education(edu, uni, tags, per="school_url")
    want_pairs = {(r.member_id) for r in edu.collect() if r.school_url in urls}
    assert {r.member_id for r in got.collect()} == want_pairs
    assert got.select("member_id", "unitid").distinct().count() == got.count()
    assert got.where("unitid is null or instnm is null").count() == 0


def test_feed_accepts_what_the_batch_accepts(spark, tables, tmp_path):
    uni = tables[0]
    tags, edu = matching.tag_list(uni), education(spark, tables)
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    edu.where("id < 80").coalesce(1).write.parquet(source)
    run_url_feed(spark, source, out, state, uni, tags)
    first = decided_urls(spark, out).count()
    edu.where("id >= 80").coalesce(2).write.mode("append").parquet(source)
    run_url_feed(spark, source, out, state, uni, tags, files_per_batch=1)
    batch = matching.school_matches(matching.matchable(edu), uni, tags, per="school_url").select("school_url")
    assert 0 < first <= decided_urls(spark, out).count()
    assert rows(decided_urls(spark, out).select("school_url").distinct()) == rows(batch.distinct())
    assert decided_urls(spark, out).count() == batch.distinct().count()
    before = accepted_rows(spark, out).count()
    want = matching.matchable(edu).join(decided_urls(spark, out).select("school_url"), "school_url").select("id")
    assert rows(accepted_rows(spark, out).select("id")) == rows(want)
    run_url_feed(spark, source, out, state, uni, tags)
    assert accepted_rows(spark, out).count() == before


def test_duplicate_report(spark):
    data = [(1, 7, "a", "u"), (2, 7, "b", "u"), (3, 7, "c", "v"), (4, 8, "a", "u"), (5, 8, "a", "w")]
    df = spark.createDataFrame(data, "id long, member_id long, title string, school_url string")
    assert rows(matching.duplicate_education_report(df).select("id")) == [(1,), (2,), (3,)]
