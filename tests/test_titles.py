"""The golden titles and the flag rules."""

from careerloom.operators import titles

FALSE = """Founding Member; Founding Engineer; Founding Partner; Founding Team; Homeowner Claims Adjuster;
Landowner Assistance Forester; Product Owner; System Owner; Account Owner; Project Owner; Brand Owner; Solution Owner;
Experience Owner; Engagement Owner; Owner's Assistant; Assistant to Founder; Executive Assistant to Founder & CEO;
Future Owner; Aspiring Founder; Future Founder; Dog Owner; Horse Owner; Employee Owner; Employee-Owner; Confounder;
Founders Fellow; Founders Club Admin; Owner Advisor"""
TRUE = """Founder; Co-Founder; Owner; Co-Owner; Founder & CEO; Founder & Chief Executive Officer;
Co-Founder & Managing Partner; Founder, President & CEO; Owner & Creative Director; Salon Owner / Hairstylist;
Co-Founder & Founding Engineer; Co-Founder And Founding Engineer; Co-Founder and Founders Board Member;
Co-Founder & Executive Assistant to Founder"""


def split(text):
    return [t.strip() for t in text.replace("\n", " ").split(";")]


def flagged(spark, names, **kw):
    rows = [(i, t, "Acme Inc", "u", "March 2001") for i, t in enumerate(names)]
    df = spark.createDataFrame(rows, "id long, title string, company_name string, company_url string, date_from string")
    return titles.founder_owner_flags(df, **kw)


def test_golden_titles(spark):
    expected = {t: False for t in split(FALSE)} | {t: True for t in split(TRUE)}
    assert len(split(FALSE)) == 28 and len(split(TRUE)) == 14
    got = {r.title: r.is_founder_or_owner for r in flagged(spark, list(expected)).collect()}
    assert got == expected


def test_null_title_and_year(spark):
    r = flagged(spark, [None]).first()
    assert r.job_from == 2001
    assert not (r.is_founder_only or r.is_owner_only or r.is_coowner_only_title or r.is_founder_or_owner_inc)


def test_compound_title_keeps_cofounder(spark):
    r = flagged(spark, ["Co-Founder & Founding Engineer"], with_long_title=True).first()
    assert r.is_cofounder_only_title and r.is_cofounder_or_coowner_title and r.is_founder_or_owner_inc and r.long_title


def test_coowner_without_a_word_of_its_own(spark):
    r = flagged(spark, ["Coowner"]).first()
    assert r.is_coowner_only_title and not r.is_owner_only


def test_entrepreneurs_need_a_flag(spark):
    import pytest

    df = flagged(spark, ["Owner", "Analyst"])
    assert titles.select_entrepreneurs(df.drop("is_founder_or_owner")).count() == 1
    with pytest.raises(ValueError):
        titles.select_entrepreneurs(df.select("title"))


def test_founder_titles_filter(spark):
    df = spark.createDataFrame([("Product Owner",), ("process owner",), ("Owner",), (None,)], "title_experience string")
    assert sorted(r[0] or "" for r in titles.filter_founder_titles(df).collect()) == ["", "Owner"]
