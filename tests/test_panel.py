"""The panel: joins, windows, collapse, majors."""

import pytest
from pyspark.sql import functions as F

from careerloom.functions import fixed_values as fx
from careerloom.operators import companies, education, panel
from careerloom.operators.relational import Skew, measure_skew
from careerloom.plans import catalogue
from conftest import rows


@pytest.fixture(scope="module")
def jobs(spark, sf):
    from careerloom.session import stored

    return stored(catalogue.career_jobs(spark, sf), "test-jobs")


def test_flags_grow_with_the_window(jobs):
    for flag in ("is_founder_or_owner", "worked_in_sales"):
        for kind in "op":
            three, five, ten = (F.col(f"{flag}_{n}_years_{kind}") for n in fx.WINDOW_YEARS)
            assert jobs.where((three & ~five) | (five & ~ten)).count() == 0


def test_person_is_any_of_the_jobs(jobs):
    person = panel.collapse_to_person(jobs)
    assert person.count() == jobs.select(*fx.PERSON_KEYS).distinct().count()
    flag = "is_founder_or_owner_10_years_o"
    assert person.where(flag).count() == jobs.where(flag).select(*fx.PERSON_KEYS).distinct().count()


def test_window_truth_table(spark):
    data = [(True, 2003, None, 2000), (True, 2004, None, 2000), (True, 2004, 2001.0, 2000), (True, 2001, 2010.0, 2000),
            (True, None, None, 2000), (True, None, 2001.0, 2000), (True, 2001, None, None), (False, 2001, None, None)]
    df = spark.createDataFrame(data, "f boolean, job_from int, company_page_founded_year double, year_to int").coalesce(1)
    got = [tuple(r) for r in panel.time_window_flags(df, ["f"], [3]).select("f_3_years_o", "f_3_years_p").collect()]
    assert got == [(True, True), (False, False), (False, True), (True, False), (False, False), (False, True), (None, None), (False, False)]


def test_dedupe_before_the_join_equals_dedupe_after(spark):
    exp = spark.createDataFrame(
        [(1, 7, "a", "u", "1", None), (2, 7, "a", "u", "1", None), (3, 7, "b", None, "1", "2"), (4, 8, "a", "u", "1", None), (5, None, "a", "u", "1", None)],
        "id long, member_id long, title string, company_url string, date_from string, date_to string")
    edu = spark.createDataFrame(
        [(10, 7, "s", "x", "1", "2", 1), (11, 7, "s", "y", "1", "2", 1), (12, 7, "s", "y", "1", "2", 2), (13, None, "s", "y", "1", "2", 2)],
        "id long, member_id long, title string, subtitle string, date_from string, date_to string, unitid int")
    got = rows(panel.join_experience_education(exp, edu).select("id_experience", "id_education"))
    assert got == [(1, 10), (1, 12), (3, 10), (3, 12)]


def test_spine_shuffles_once_a_side_and_splits_hot_members(spark, capsys):
    jobs = [(i, 7 if i % 3 else i, f"t{i % 50}", f"c{i % 90}", "u", "1", "2") for i in range(600)] + [(900, None, "t", "c", "u", "1", "2")]
    degrees = [(i, 7 if i < 4 else i, f"s{i % 3}", "x", "1", "2", i % 2) for i in range(40)]
    exp = spark.createDataFrame(jobs, "id long, member_id long, title string, company_name string, company_url string, date_from string, date_to string")
    edu = spark.createDataFrame(degrees, "id long, member_id long, title string, subtitle string, date_from string, date_to string, unitid int")
    one, two = {}, {}
    for i, m, *rest in jobs:
        one.setdefault((m, rest[0], *rest[2:]), []).append((rest[1], i))
    for i, m, *rest in degrees:
        two.setdefault((m, rest[0], *rest[2:]), []).append((rest[1], i))
    want = [(min(a)[1], min(b)[1]) for k, a in one.items() for h, b in two.items() if k[0] == h[0] and k[0] is not None]
    assert measure_skew(exp, "member_id").values == (7,)
    hot = panel.join_experience_education(exp, edu)
    plain = panel.join_experience_education(exp, edu, skew=Skew())
    assert [len(rows(df.select("id_experience", "id_education"))) for df in (hot, plain)] == [len(want)] * 2
    keys = lambda df: {(r.member_id, r.title_experience, r.unitid, r.title_education) for r in df.collect()}
    assert keys(hot) == keys(plain) == {(k[0], k[1], h[4], h[1]) for k in one for h in two if k[0] == h[0] and k[0] is not None}
    capsys.readouterr()
    plain.explain()
    assert "Exchange hashpartitioning" not in capsys.readouterr().out


def test_major_dummies_sum_to_one(spark):
    majors = ["Computer Science", "second thoughts", "flaw", "Landscape", "Nothing", None, "M.B.A. of x", "mxbxax", "Asian Studies", ""]
    df = spark.createDataFrame([(m,) for m in majors], "university_major_clean string")
    done = education.categorise_major(df)
    assert done.where(sum(F.col(c) for c in education.major_columns()) != 1).count() == 0
    got = {r[0]: r.university_major_categorized for r in done.collect()}
    assert got["Computer Science"] == "Engineering or Computer" and got["second thoughts"] == "Economics and Finance"
    assert got["flaw"] == got["Landscape"] == "Law / Climinology" and got[None] == got["Nothing"] == got["mxbxax"] == "Other"
    assert got["M.B.A. of x"] == "Business (not Economics / Finance)" and got["Asian Studies"] == "Social Science (not Economics)"


def test_bachelor_and_clean_major(spark):
    raw = ["Bachelor of Science (B.S.), Physics", "(BS)", "basket", "master's degree, Art", "History, Minor in Music", None, "undergraduate"]
    df = spark.createDataFrame([(m,) for m in raw], "university_major_raw string")
    flags = {r[0]: r.bachelors_degree for r in education.bachelors_flag(df).collect()}
    assert [flags[m] for m in raw] == [True, False, True, False, False, False, True]
    cleaned = {r[0]: r.university_major_clean for r in education.clean_major(df).collect()}
    assert "(BS)" not in cleaned and cleaned["Bachelor of Science (B.S.), Physics"] == "Physics"
    assert cleaned["master's degree, Art"] == "Art" and cleaned["History, Minor in Music"] == "History," and cleaned[None] is None


def test_clean_education_is_case_sensitive_and_picks_the_first_row_first(spark):
    data = [(1, "X", "Bachelor of Arts", "u"), (1, "A", "PhD", "u"), (2, "DeVry University", "BS", "u"), (3, "Y", "bachelor of arts", "u"),
            (4, "Y", "MBA", "https://www.linkedin.com/edu/school"), (5, None, "MBA", None), (6, "Y", "MS, Nursing", "u"), (7, "Y", None, "u")]
    df = spark.createDataFrame(data, "id long, title string, subtitle string, school_url string")
    assert rows(education.clean_education(df).select("id")) == [(5,)]


def test_graduation_years(spark):
    df = spark.createDataFrame([(1, "1990", "1995"), (2, None, "1995"), (3, "1995", "2005"), (4, "x", "1999")], "id int, date_from string, date_to string")
    assert rows(education.filter_graduation_years(df).select("id")) == [(1,)]
    assert rows(education.filter_graduation_years(df, mode="either").select("id")) == [(1,), (3,)]
    with pytest.raises(ValueError):
        education.filter_graduation_years(df, mode="other")


def test_verification_sample_sizes(spark, sf, jobs):
    person = panel.collapse_to_person(jobs).withColumn("university_major_clean", F.lit("x"))
    exp = catalogue.flagged(spark, sf)
    got = panel.verification_sample(exp, person, n=25).groupBy("is_founder_or_owner_with_url").count()
    assert rows(got) == [(False, 25), (True, 25)]


def test_a_known_gender_probability_wins_over_an_empty_profile(spark):
    person = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "linkedin_member_id long, university_title string")
    profiles = spark.createDataFrame([(1, None), (1, 0.4), (1, 0.3), (2, None), (None, 0.9)], "id long, prob_female double")
    got = rows(panel.add_gender_probability(person, profiles).select("linkedin_member_id", "prob_female"))
    assert got == sorted([(1, 0.3), (2, None), (3, None), (None, None)], key=repr)


def test_majors_by_plain_tests_equal_the_patterns(spark):
    words = [w for _, _, ws in fx.MAJORS for w in ws]
    texts = [f"Master's degree, {w.upper()} minor in Xyz" for w in words] + [
        "BS", "BS Law", "bachelor of science (B.S.), mathematics", "MASTERS, in Law", "Minor", "minors of x", "(BS)", "(toolong)", "( a", "", None, " b.s. ",
        "Business m.b.a. x", "mxbxax", "Earthly", "x master of y", "master of science(ms), econ", "donor Minor art, b", "ſKMASTER'S x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, university_major_raw string")
    lowered = F.lower("university_major_clean")
    branch = F
    for label, _, ws in fx.MAJORS:
        branch = branch.when(lowered.rlike("|".join(w.replace(".", r"\.") for w in ws)), label)
    text = F.trim(F.regexp_replace("university_major_raw", "(?i)" + "|".join(fx.DEGREE_PREFIXES), ""), F.lit(" \t\n\x0b\f\r"))
    text = F.trim(F.regexp_replace(text, fx.MINOR_TAIL, ""), F.lit(" \t\n\x0b\f\r"))
    want = df.select("id", text.alias("university_major_clean")).where(
        ~F.coalesce(F.col("university_major_clean").rlike(fx.SHORT_NOTE), F.lit(False))).withColumn("c", branch.otherwise("Other"))
    done = education.categorise_major(education.clean_major(df))
    assert rows(done.select("id", "university_major_clean", "university_major_categorized")) == rows(want)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE(lower(" not in plan.replace("rlike", "RLIKE")


def test_one_row_group_is_dealt_out_however_many_splits_it_has(spark, tmp_path):
    from careerloom.plans import fixtures

    spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(
        str(tmp_path / "documents.parquet"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "16k")
        df = fixtures.table(spark, str(tmp_path), "documents")
        cores = spark.sparkContext.defaultParallelism
        assert df.select(F.spark_partition_id()).distinct().count() >= cores and df.count() == 4000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_ids_are_told_apart_inside_members_and_across_them(spark):
    data = [(1, 7, "b", "u"), (1, 7, "a", "u"), (1, 7, "a", "u"), (2, 8, "a", "u"), (2, 7, "b", "u"), (2, 9, "a", None), (3, 9, "a", "u"),
            (4, 6, "a", "u"), (4, 8, "c", "u"), (4, None, "a", "u"), (None, 7, "a", "u"), (None, 8, "a", "u"), (5, 8, None, "u")]
    exp = spark.createDataFrame(data, "id long, member_id long, title string, company_url string")
    edu = spark.createDataFrame([(7,), (7,), (8,), (9,), (None,)], "member_id long")
    inside = exp.where("id in (1, 3, 5)")
    for jobs in (exp, inside):
        want = rows(panel.restrict_experience(jobs, edu))
        assert rows(panel.first_of_id(panel.ids_within_members(jobs, edu))) == want and len({r[0] for r in want}) == len(want)
    limit = panel.MEMBERS
    try:
        panel.MEMBERS = 1
        assert rows(panel.restrict_experience(exp, edu)) == rows(panel.first_of_id(panel.ids_within_members(exp, edu)))
    finally:
        panel.MEMBERS = limit


def test_rows_of_single_ids_are_not_moved(spark, monkeypatch):
    def moved(*_, **__):
        raise AssertionError("all rows were moved")

    monkeypatch.setattr(panel, "keep_first", moved)
    exp = spark.createDataFrame([(1, 7, "a"), (2, 7, "a"), (None, 8, "b"), (3, 9, "a")], "id long, member_id long, title string")
    edu = spark.createDataFrame([(7,), (8,)], "member_id long")
    assert rows(panel.restrict_experience(exp, edu)) == sorted([(1, 7, "a"), (2, 7, "a"), (None, 8, "b")], key=repr)


def test_outcomes_need_no_founding_years(spark, sf, monkeypatch):
    def looked_up(*_, **__):
        raise AssertionError("years were looked up")

    person = panel.collapse_to_person(catalogue.career_jobs(spark, sf))
    flags = [f"is_founder_or_owner_{n}_years_o" for n in (3, 5, 10)]
    want = person.groupBy("unitid", "year_end_college").agg(F.count("*"), *[F.round(F.avg(F.col(c).cast("int")), 6) for c in flags])
    want = rows(want)
    monkeypatch.setattr(companies, "founding_years", looked_up)
    assert rows(catalogue.school_outcomes(spark, sf)) == want


def test_review_sample_is_that_of_all_rows(spark):
    exp = spark.createDataFrame(
        [(i, i % 40, f"t{i}", None, "u", i % 3 == 0) for i in range(300)],
        "id long, member_id long, title string, company_name string, company_url string, is_founder_or_owner_with_url boolean")
    person = spark.createDataFrame([(m, f"s{k}", k) for m in range(30) for k in range(2)], "linkedin_member_id long, university_title string, major_math int")
    joined = exp.join(person.withColumn("member_id", F.col("linkedin_member_id")), "member_id")
    for n in (5, 1000):
        got = rows(panel.verification_sample(exp, person, n))
        kinds = [panel.sample_n(joined.select(
            "id", "title", "company_name", "company_url", "linkedin_member_id", "university_title", "is_founder_or_owner_with_url", "major_math"
        ).where(F.col("is_founder_or_owner_with_url") == kind), n, "id") for kind in (True, False)]
        assert got == rows(kinds[0].unionByName(kinds[1]))
