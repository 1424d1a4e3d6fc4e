"""Ownership measures on hand-made careers."""

import pytest

from careerloom.operators import companies, ownership, relational
from careerloom.session import scratch_path
from conftest import rows

SCHEMA = ("member_id long, company_name string, company_url string, is_founder_only boolean, is_owner_only boolean, "
          "job_from int, title string")


def frame(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    return df.selectExpr("*", "is_founder_only or is_owner_only as is_founder_or_owner")


@pytest.fixture(scope="module")
def careers(spark):
    data = [(i, "Chain", "c", False, True, 2000, "Owner") for i in range(16)]
    data += [(99, "Chain", "c", False, False, 1999, "Clerk")]
    data += [(i, "Fifteen", "f", False, True, 2000, "Owner") for i in range(15)]
    data += [(i, "Mixed", "m", i < 4, True, 2000, "Founder, Owner") for i in range(20)]
    data += [(i, n, None, False, True, 2000, "Owner") for n in ("self employed", "Freelance", ".", None) for i in range(20)]
    data += [(1, "Twice", "t", True, True, 2000, "Founder & Owner")]
    return frame(spark, data)


def test_franchise(careers):
    out = ownership.franchise_flags(careers)
    flagged = out.where("franchise_owner").select("company_name").distinct()
    assert rows(flagged) == [("Chain",)]
    assert out.where("company_name = 'Chain' and title = 'Clerk' and franchise_founder_or_owner").count() == 0
    assert out.count() == careers.count()
    kept = {r.company_name: r.share_founders_vs_owners for r in ownership.company_ownership(careers).collect()}
    assert kept == {"Chain": 0.0, "Fifteen": 0.0, "Mixed": 0.2, "Twice": 1.0}


def test_cofounder_flag_counts_flags_not_people(careers):
    got = ownership.cofounder_flags(careers).where("cofound_coown_same_url").select("company_url").distinct()
    assert rows(got) == [("t",)]


def test_employee_before_founder(spark):
    df = frame(spark, [
        (1, "A", "a", True, False, 2000, "Founder"), (2, "A", "a", False, False, 1999, "Clerk"),
        (3, "B", "b", True, False, 2000, "Founder"), (4, "B", "b", False, False, None, "Clerk"),
        (5, None, None, True, False, 2005, "Entrepreneur"), (6, None, None, False, False, 1990, "Clerk"),
        (7, "C", "c", False, False, 1990, "Entrepreneur"),
    ])
    out = ownership.employee_before_founder_filter(df)
    got = {r.member_id: (r.flt_is_founder_or_owner, r.ih_flt_is_founder_or_owner) for r in out.collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (True, True), 4: (False, False), 5: (True, True), 6: (False, False), 7: (False, True)}
    null_name = [r for r in out.collect() if r.company_name is None]
    assert all(r.flt_company_employee_start_year is None for r in null_name)


def test_first_years_are_looked_up_by_their_measured_size(spark, monkeypatch):
    """An aggregate that Spark expects to be large, but is small, neither costs a sketch of the keys nor moves the rows."""
    def measured(*_, **__):
        raise AssertionError("the keys were measured")

    monkeypatch.setattr(relational, "measure_skew", measured)
    spark.range(200_000).selectExpr(
        "id as member_id", "'Firm ' || id % 5 as company_name", "'u' as company_url", "id % 2 = 0 as is_founder_only",
        "false as is_owner_only", "cast(2000 + id % 7 as int) as job_from", "'Founder' as title", "id % 2 = 0 as is_founder_or_owner",
    ).write.mode("overwrite").parquet(path := scratch_path(spark, "careers"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        out = ownership.employee_before_founder_filter(spark.read.parquet(path))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert rows(out.groupBy("flt_company_employee_start_year", "flt_company_founder_start_year").count()) == [(2000, 2000, 200_000)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_strict_events_by_name_and_with_the_published_slip(spark):
    data = [(u * 10 + i, "Same", f"u{u}", True, False, 2000, "Founder") for u in range(6) for i in range(2)]
    data += [(900 + i, "Other", "o", True, False, 2000 + 5 * i, "Founder") for i in range(2)]
    df = frame(spark, data).selectExpr("*", "is_founder_or_owner as is_founder_or_owner_with_url")
    fixed = ownership.cofounder_events_strict(df)
    assert rows(fixed.select("linkedin_member_id")) == [(900,)]
    assert ownership.cofounder_events_strict(df, parity=True).count() == 13


def test_founding_year(spark):
    exp = spark.createDataFrame([(1, "http://uk.linkedin.com/company/A/"), (2, "linkedin.com/company/b?x"), (3, None), (4, "z")],
                                "id long, company_url string")
    com = spark.createDataFrame([("https://www.linkedin.com/company/a", "2001"), ("x.linkedin.com/company/a", "1999"),
                                 ("linkedin.com/company/b", "1700"), (None, "2000"), ("z", "junk")], "url string, founded string")
    got = rows(companies.founding_year(exp, com).select("id", "company_page_founded_year"))
    assert got == [(1, 1999.0), (2, None), (3, None), (4, None)]
    assert companies.founding_year(exp, None) is exp and companies.merge_company_scores(exp, None) is exp
