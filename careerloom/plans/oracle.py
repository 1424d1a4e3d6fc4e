"""Oracle SQL: what each catalogue query must return, in DuckDB's dialect.

Written from the rules, not from the Spark plans: window functions, correlated
conditions and plain distinct counts where the operators use other routes.
"""

from __future__ import annotations

from careerloom.functions import fixed_values as fx
from careerloom.operators.education import major_columns
from careerloom.plans.fixtures import GENERIC_SUFFIX, with_clauses

ORACLE: dict[str, str] = {}


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def add(name: str, views: str, body: str, **ctes: str) -> None:
    parts = [with_clauses(*views.split())] if views else []
    parts += [f"{k} AS ({v})" for k, v in ctes.items()]
    parts = [p for p in parts if p]
    ORACLE[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def found(col: str, pattern: str, ci: bool = True) -> str:
    return f"coalesce(regexp_matches({col}, {q(pattern)}{', ' + q('i') if ci else ''}), false)"


def any_found(col: str, patterns: list[str], ci: bool = True) -> str:
    return "(" + " OR ".join(found(col, p, ci) for p in patterns) + ")"


def first_row(table: str, keys: str, order: list[str], where: str = "true") -> str:
    by = ", ".join(f"{c} NULLS FIRST" for c in order)
    return (
        f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {by}) AS rn "
        f"FROM {table} WHERE {where}) WHERE rn = 1"
    )


YEAR = "try_cast(try_cast(trim({c}) AS DOUBLE) AS INTEGER)"
JOB_YEAR = r"try_cast(nullif(regexp_extract(date_from, '\d{4}'), '') AS INTEGER)"

EDU = ["member_id", "title", "subtitle", "school_url", "date_from", "date_to", "unitid"]
EXP = ["member_id", "title", "company_name", "company_url", "date_from", "date_to"]

DATED_EDU = f"SELECT *, {YEAR.format(c='date_from')} AS year_from, {YEAR.format(c='date_to')} AS year_to FROM education"
CLEAN_EDU = f"""SELECT *, {YEAR.format(c='date_from')} AS year_from, {YEAR.format(c='date_to')} AS year_to
  FROM ({first_row('education', 'id', EDU, 'NOT ' + found('title', fx.ONLINE_SCHOOLS))})
  WHERE (school_url IS NULL OR NOT suffix(school_url, {q(GENERIC_SUFFIX)})) AND subtitle IS NOT NULL
    AND ({found('subtitle', fx.BACHELOR_DEGREE, False)} OR {found('subtitle', fx.MASTER_DEGREE, False)})
    AND NOT {any_found('subtitle', fx.OTHER_DEGREES, False)}"""
BASE_EXP = first_row("experience", "id", EXP, "member_id IN (SELECT member_id FROM clean_edu)")


def flags(table: str) -> str:
    stripped = "title"
    for p in fx.WEAK_FOUNDER_PHRASES:
        stripped = f"regexp_replace({stripped}, {q(p)}, '', 'gi')"
    return f"""SELECT *,
    is_founder_only OR is_owner_only AS is_founder_or_owner,
    is_cofounder_only_title OR is_coowner_only_title AS is_cofounder_or_coowner_title,
    (is_founder_only OR is_owner_only) AND company_url IS NOT NULL AS is_founder_or_owner_with_url,
    (is_founder_only OR is_owner_only) AND {found('company_name', fx.INCORPORATED_NAME)} AS is_founder_or_owner_inc
  FROM (SELECT *, {JOB_YEAR} AS job_from,
    {found('title', fx.FOUNDER)} AND NOT weak_founder AS is_founder_only,
    {found('title', fx.OWNER)} AND NOT weak_owner AS is_owner_only,
    {found('title', fx.COOWNER)} AND NOT weak_owner AS is_coowner_only_title,
    {found('title', fx.COFOUNDER)} AND NOT weak_founder AS is_cofounder_only_title
    FROM (SELECT *, {any_found('title', fx.NOT_OWNER)} AS weak_owner,
      {any_found('title', fx.NOT_FOUNDER)} AND NOT {found(stripped, fx.STRONG_FOUNDER)} AS weak_founder FROM {table}))"""


FLAGGED = f"SELECT * EXCLUDE (weak_owner, weak_founder) FROM ({flags('experience')})"
CHAINED = """SELECT * REPLACE (coalesce(CASE WHEN title IN ('Owner','Co-Owner','Salon Owner / Hairstylist') AND id % 3 = 0
  THEN 'Chain ' || CAST(member_id % 7 AS VARCHAR) END, company_name) AS company_name) FROM experience"""


def canonical(c: str, host: str = r"example\.com") -> str:
    return (
        rf"regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '[?#].*$', ''), "
        rf"'^.*\.{host}', 'example.com'), '/$', '')"
    )


FOUNDED = f"""SELECT {canonical('url')} AS company_url, min(try_cast(founded AS DOUBLE)) AS y FROM companies GROUP BY 1"""


def dated(table: str) -> str:
    return f"""SELECT f.* REPLACE ({canonical('f.company_url')} AS company_url),
    CASE WHEN y BETWEEN 1900 AND 2030 THEN y END AS company_page_founded_year
    FROM {table} f LEFT JOIN founded_years c ON {canonical('f.company_url')} = c.company_url"""


# --- education and experience -----------------------------------------------

add("education_cleaned", "education", "SELECT * FROM clean_edu", clean_edu=CLEAN_EDU)
add("graduation_years", "education", """
SELECT id, year_from, year_to, 'end' AS rule FROM d WHERE year_from IS NOT NULL AND year_to BETWEEN 1995 AND 2001
UNION ALL SELECT id, year_from, year_to, 'either' FROM d WHERE year_from IS NOT NULL AND year_to IS NOT NULL
  AND (year_to BETWEEN 1991 AND 1993 OR year_from BETWEEN 1991 AND 1993)""", d=DATED_EDU)
add("experience_restricted", "education experience", BASE_EXP, clean_edu=CLEAN_EDU)
add("founder_owner_flags", "experience", FLAGGED)
add("broad_founder", "experience", f"""
SELECT title, {found('title', fx.BROAD_FOUNDER)} AS ih_is_founder_or_owner, title ILIKE '%engineer%' AS worked_as_engineer,
  title ILIKE '%sales%' AS worked_in_sales, count(*) AS n FROM experience GROUP BY ALL""")
add("founder_events_raw", "experience", f"""
SELECT * FROM experience WHERE company_url IS NOT NULL AND (title ILIKE '%founder%' OR title ILIKE '%owner%')
  AND NOT {found('title', fx.NON_FOUNDER_OWNER_TITLES)}""")

OWNERSHIP = f"""SELECT *, num_unique_founders::DOUBLE / nullif(num_unique_founders_or_owners, 0) AS share_founders_vs_owners
  FROM (SELECT company_name,
    count(DISTINCT member_id) FILTER (is_founder_only) AS num_unique_founders,
    count(DISTINCT member_id) FILTER (is_owner_only) AS num_unique_owners,
    count(DISTINCT member_id) FILTER (is_founder_or_owner) AS num_unique_founders_or_owners
    FROM f WHERE is_founder_or_owner AND company_name IS NOT NULL AND company_name NOT IN ('-', '.', 'owner', 'confidential', 'none')
      AND NOT {found('company_name', fx.PLACEHOLDER_NAME)} GROUP BY 1)"""
add("franchise_ownership", "experience", """
SELECT * REPLACE (round(share_founders_vs_owners, 6) AS share_founders_vs_owners) FROM o""",
    chained=CHAINED, f=flags("chained"), o=OWNERSHIP)
add("franchise", "experience", """
SELECT id, member_id, title, f.company_name, is_founder_or_owner AND hit.company_name IS NOT NULL AS franchise_founder_or_owner,
  is_owner_only AND hit.company_name IS NOT NULL AS franchise_owner
FROM f LEFT JOIN (SELECT company_name FROM o WHERE NOT share_founders_vs_owners > 0.7
  AND num_unique_founders_or_owners > 15 AND share_founders_vs_owners < 0.1) hit ON f.company_name = hit.company_name""",
    chained=CHAINED, f=flags("chained"), o=OWNERSHIP)
#: Tables that several parts read are computed once.
for _cte in ("experience", "chained", "f", "o"):
    ORACLE["franchise"] = ORACLE["franchise"].replace(f"\n{_cte} AS (", f"\n{_cte} AS MATERIALIZED (", 1)
add("cofounder_flag", "experience", """
SELECT id, member_id, title, company_url, is_founder_or_owner,
  is_founder_or_owner AND coalesce(company_url IN (SELECT company_url FROM f WHERE is_founder_or_owner AND company_url IS NOT NULL
    GROUP BY 1 HAVING sum(is_founder_only::INT) + sum(is_owner_only::INT) BETWEEN 2 AND 10), false) AS cofound_coown_same_url
FROM f""", f=FLAGGED)
add("shrunk_experience", "experience", """
SELECT id, company_name AS employer, is_founder_only, is_cofounder_only_title, is_founder_or_owner,
  is_cofounder_or_coowner_title, is_founder_or_owner_with_url, is_founder_or_owner_inc FROM f""", f=FLAGGED)
add("canonical_urls", "", f"SELECT page_id, {canonical('url')} AS canonical FROM pages")
add("url_duplicates", "companies", """
SELECT count(*) - count(DISTINCT url) AS duplicate_urls
FROM (SELECT trim(regexp_replace(url, '[?#].*$', '')) AS url FROM pages UNION ALL SELECT trim(url) FROM companies) WHERE url <> ''""")
add("founding_year", "experience companies", """
SELECT id, member_id, title, company_url, company_page_founded_year FROM d""",
    founded_years=FOUNDED, d=dated("experience"))

GAPS = dict(founded_years=FOUNDED, f=FLAGGED, d=dated("f"),
            gaps="SELECT *, job_from - company_page_founded_year AS v FROM d WHERE is_founder_or_owner AND job_from - company_page_founded_year IS NOT NULL")
add("founding_gap", "experience companies", "SELECT metric, round(value, 6) AS value FROM (" + " UNION ALL ".join(
    [f"SELECT '{m}' AS metric, {e}::DOUBLE AS value FROM gaps" for m, e in [
        ("count", "count(v)"), ("mean", "avg(v)"), ("std", "stddev_samp(v)"), ("min", "min(v)"), ("max", "max(v)")]]
    + [f"SELECT 'p{round(p * 100)}' AS metric, quantile_cont(v, {p}) AS value FROM gaps" for p in fx.GAP_PERCENTILES]) + ")", **GAPS)
add("founding_gap_signs", "experience companies", """
SELECT direction, n, round(n / (SELECT count(*) FROM gaps)::DOUBLE, 6) AS share FROM (
  SELECT 'before_founded' AS direction, count(*) FILTER (v < 0) AS n FROM gaps
  UNION ALL SELECT 'same_year', count(*) FILTER (v = 0) FROM gaps
  UNION ALL SELECT 'after_founded', count(*) FILTER (v > 0) FROM gaps)""", **GAPS)
_GAP_COLS = "id, member_id, title, company_name, job_from, company_page_founded_year"
_GAP_TIES = ", ".join(f"{c} NULLS FIRST" for c in _GAP_COLS.split(", "))
add("founding_gap_extremes", "experience companies", f"""
SELECT * FROM (SELECT {_GAP_COLS}, v AS year_diff, 'smallest' AS side FROM gaps ORDER BY v, {_GAP_TIES} LIMIT 10)
UNION ALL SELECT * FROM (SELECT {_GAP_COLS}, v, 'largest' FROM gaps ORDER BY v DESC, {_GAP_TIES} LIMIT 10)""", **GAPS)

PRECEDENCE = f"""SELECT *, coalesce(e < fo, false) AS flt_employee_before_founder,
  is_founder_or_owner AND NOT coalesce(e < fo, false) AS flt_is_founder_or_owner,
  {found('title', fx.BROAD_FOUNDER)} AND NOT coalesce(e < fo, false) AS ih_flt_is_founder_or_owner
  FROM (SELECT *, CASE WHEN company_name IS NOT NULL THEN min(job_from) OVER w END AS e,
    CASE WHEN company_name IS NOT NULL THEN min(job_from) FILTER (is_founder_or_owner) OVER w END AS fo
    FROM f WINDOW w AS (PARTITION BY company_name))"""
add("employee_before_founder", "experience", """
SELECT id, member_id, title, company_name, CASE WHEN is_founder_or_owner THEN job_from END AS founder_job_from,
  e AS flt_company_employee_start_year, fo AS flt_company_founder_start_year, flt_employee_before_founder,
  flt_is_founder_or_owner, ih_flt_is_founder_or_owner FROM p""", f=FLAGGED, p=PRECEDENCE)
DEFS = ["is_founder_or_owner", "flt_is_founder_or_owner", "ih_flt_is_founder_or_owner", "is_founder_or_owner_with_url"]
add("definition_summary", "experience", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n_known, count(*) FILTER ({c}) AS n_true, "
    f"round(avg({c}::INT), 6) AS share_true FROM p" for c in DEFS), f=FLAGGED, p=PRECEDENCE)
add("definition_pairs", "experience", " UNION ALL ".join(
    f"SELECT '{a}' AS first, '{b}' AS second, count(*) FILTER ({a} IS DISTINCT FROM {b}) AS n_differ FROM p"
    for i, a in enumerate(DEFS) for b in DEFS[i + 1:]), f=FLAGGED, p=PRECEDENCE)
add("definition_counts", "experience", f"""
SELECT {', '.join(DEFS)}, count(*) AS n, round(count(*) / (SELECT count(*) FROM p)::DOUBLE, 6) AS share FROM p GROUP BY ALL""",
    f=FLAGGED, p=PRECEDENCE)
add("definition_differences", "experience", f"""
SELECT id, title, company_name, company_url, {', '.join(DEFS)} FROM p
WHERE NOT ({DEFS[0]} = {DEFS[1]} AND {DEFS[0]} = {DEFS[2]} AND {DEFS[0]} = {DEFS[3]})""", f=FLAGGED, p=PRECEDENCE)
add("definition_crosstab", "experience", """
SELECT CASE WHEN grouping(a) = 1 THEN 'All' ELSE a END AS is_founder_or_owner,
  CASE WHEN grouping(b) = 1 THEN 'All' ELSE b END AS ih_is_founder_or_owner, count(*) AS n FROM x GROUP BY CUBE (a, b)""",
    f=FLAGGED, x=f"SELECT is_founder_or_owner::VARCHAR AS a, ({found('title', fx.BROAD_FOUNDER)})::VARCHAR AS b FROM f")


def label_of(p: str) -> str:
    whens = " ".join(f"WHEN {p} >= {cut} THEN {q(label)}" for cut, label in zip(fx.LABEL_CUTS, fx.LABEL_ORDER))
    return f"CASE WHEN {p} IS NULL THEN NULL {whens} ELSE {q(fx.LABEL_ORDER[-1])} END"


SCORED = f"SELECT *, {label_of('fb_ad_prob')} AS fb_ad_likelihood FROM company_scores"
add("scores_joined", "experience company_scores", """
SELECT e.*, round(s.fb_ad_prob, 6) AS fb_ad_prob, s.fb_ad_likelihood FROM experience e LEFT JOIN s USING (company_name)""", s=SCORED)
add("company_scores_joined", "experience company_scores", """
SELECT e.*, round(s.fb_ad_prob * 2, 6) AS fb_ad_prob FROM experience e LEFT JOIN company_scores s USING (company_name)""")

# --- panel ------------------------------------------------------------------


def joined(exp: str, edu: str, exp_cols: list[str]) -> str:
    """All pairs first, repeats dropped after: the rule as stated."""
    order_e = ", ".join(f"e.{c} NULLS FIRST" for c in exp_cols)
    order_d = ", ".join(f"d.{c} NULLS FIRST" for c in ["id", "subtitle", "school_url", "year_from", "year_to"])
    return f"""SELECT * EXCLUDE (rn) FROM (
  SELECT e.* EXCLUDE (id, title, date_from, date_to), e.id AS id_experience, e.title AS title_experience,
    e.date_from AS date_from_experience, e.date_to AS date_to_experience, d.id AS id_education, d.title AS title_education,
    d.date_from AS date_from_education, d.date_to AS date_to_education, d.subtitle, d.school_url, d.unitid, d.year_from, d.year_to,
    row_number() OVER (PARTITION BY e.member_id, e.title, e.company_url, e.date_from, e.date_to, d.title, d.date_from, d.date_to,
      d.unitid ORDER BY {order_e}, {order_d}) AS rn
  FROM {exp} e JOIN {edu} d ON e.member_id = d.member_id) WHERE rn = 1"""


add("exp_edu_join", "experience education", """
SELECT id_experience, id_education, member_id, title_experience, title_education, company_name, company_url,
  date_from_experience, date_to_experience, unitid, year_from, year_to FROM j""",
    d=DATED_EDU, j=joined("experience", "d", ["id", "company_name"]))
add("members_with_education", "profiles education", """
SELECT p.id, round(prob_female, 6) AS prob_female, e.id AS id_education, title, subtitle, year_to
FROM profiles p JOIN clean_edu e ON p.id = e.member_id""", clean_edu=CLEAN_EDU)
add("member_counts", "profiles education", """
SELECT (SELECT count(DISTINCT id) FROM profiles) AS members, (SELECT count(DISTINCT member_id) FROM clean_edu) AS education_members,
  (SELECT count(DISTINCT member_id) FROM clean_edu JOIN profiles p ON p.id = member_id) AS members_with_education""",
    clean_edu=CLEAN_EDU)

FLAG_COLS = ["worked_as_engineer", "worked_in_sales", "is_founder_only", "is_owner_only", "is_coowner_only_title",
             "is_cofounder_only_title", "is_founder_or_owner", "is_cofounder_or_coowner_title",
             "is_founder_or_owner_with_url", "is_founder_or_owner_inc"]


def in_window(c: str, n: int, kind: str) -> str:
    limit = f"(year_to + {n})"
    own = f"CASE WHEN job_from IS NULL THEN false ELSE job_from <= {limit} END"
    if kind == "p":
        own = f"CASE WHEN company_page_founded_year IS NOT NULL THEN company_page_founded_year <= {limit} ELSE {own} END"
    return f"{c} AND ({own}) AS {c}_{n}_years_{kind}"


WINDOWED = [in_window(c, n, k) for c in FLAG_COLS for n in fx.WINDOW_YEARS for k in "op"]
WINDOW_NAMES = [f"{c}_{n}_years_{k}" for c in FLAG_COLS for n in fx.WINDOW_YEARS for k in "op"]
JOBS = dict(
    clean_edu=CLEAN_EDU,
    base_exp=BASE_EXP,
    started="SELECT * FROM base_exp WHERE date_from IS NOT NULL",
    founded_years=FOUNDED,
    f=flags("started"),
    d=dated("f"),
    j=joined("d", "clean_edu", ["id", "company_name"]),
    jobs="SELECT *, " + ", ".join(WINDOWED) + " FROM (SELECT *, title_experience ILIKE '%engineer%' AS worked_as_engineer, "
         "title_experience ILIKE '%sales%' AS worked_in_sales FROM j)",
)
PERSON = dict(JOBS, person="""SELECT member_id AS linkedin_member_id, year_to AS year_end_college, year_from AS year_start_college,
  title_education AS university_title, subtitle AS university_major_raw, unitid, """
  + ", ".join(f"bool_or({c}) AS {c}" for c in WINDOW_NAMES) + " FROM jobs GROUP BY ALL")
JOB_VIEWS = "experience education companies"
add("window_flags", JOB_VIEWS, "SELECT id_experience, member_id, job_from, year_to, company_page_founded_year, " + ", ".join(
    c for c in WINDOW_NAMES if c.startswith(("is_founder_or_owner_", "worked_as_engineer_"))) + " FROM jobs", **JOBS)
add("person_panel", JOB_VIEWS, "SELECT * FROM person", **PERSON)
add("school_outcomes", JOB_VIEWS, "SELECT unitid, year_end_college, count(*) AS graduates, " + ", ".join(
    f"round(avg(is_founder_or_owner_{n}_years_o::INT), 6) AS share_{n}_years" for n in fx.WINDOW_YEARS)
    + " FROM person GROUP BY ALL", **PERSON)

MAJORS_RAW = """SELECT id, subtitle AS university_major_raw FROM education
  UNION ALL SELECT doc_id + 10000000, text FROM documents"""
_STARTS = " OR ".join(found("lower(university_major_raw)", "^" + p, False) for p in fx.BACHELOR_STARTS)
_STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_CUT = _STRIP.format(c=f"regexp_replace(university_major_raw, {q('|'.join(fx.DEGREE_PREFIXES))}, '', 'gi')")
_CUT = _STRIP.format(c=f"regexp_replace({_CUT}, {q(fx.MINOR_TAIL)}, '', 'g')")
MAJORS = dict(
    raw=MAJORS_RAW,
    cleaned=f"SELECT *, {_CUT} AS university_major_clean FROM raw",
    m=f"""SELECT id, ({_STARTS}) AS bachelors_degree, university_major_clean FROM cleaned
      WHERE NOT coalesce(regexp_matches(university_major_clean, {q(fx.SHORT_NOTE)}), false)""",
    c="SELECT id, CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(university_major_clean), {q(w)})" for w in words) + f" THEN {q(label)}"
        for label, _, words in fx.MAJORS) + " ELSE 'Other' END AS university_major_categorized FROM m",
    dummies="SELECT *, " + ", ".join(
        f"(university_major_categorized = {q(label)})::INT AS major_{name}"
        for label, name in [(x, y) for x, y, _ in fx.MAJORS] + [fx.OTHER_MAJOR]) + " FROM c",
)
add("bachelors_and_major_clean", "education", "SELECT * FROM m", **MAJORS)
add("major_category", "education", "SELECT * FROM dummies", **MAJORS)
add("major_summary", "education", " UNION ALL ".join(
    f"SELECT '{c}' AS category, sum({c})::BIGINT AS n, round(100.0::DOUBLE * sum({c}) / count(*), 6) AS pct FROM dummies"
    for c in major_columns()), **MAJORS)

_EVENT = """member_id AS linkedin_member_id, company_name, company_url, title_experience, date_from_experience AS start_founder_date,
  date_to_experience AS end_founder_date, year_from AS year_start_college, year_to AS year_end_college,
  title_education AS university_title, unitid"""
add("cofounder_events", JOB_VIEWS, f"""
SELECT DISTINCT {_EVENT} FROM jobs WHERE is_founder_or_owner_5_years_o AND company_url IN (
  SELECT company_url FROM jobs WHERE is_founder_or_owner_5_years_o AND company_url IS NOT NULL
  GROUP BY 1 HAVING count(DISTINCT member_id) BETWEEN 2 AND 10)""", **JOBS)
add("cofounder_strict", JOB_VIEWS, """
SELECT member_id AS linkedin_member_id, id_experience, company_name, company_url, unique_member_count, first_year_cofound, job_from
FROM e WHERE job_from <= first_year_cofound + 4 AND (company_name IS NULL OR company_name NOT IN (
  SELECT company_name FROM e WHERE company_name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT member_id) > 10))""",
    **JOBS,
    u="SELECT company_url, count(DISTINCT member_id) AS unique_member_count FROM jobs WHERE is_founder_or_owner_with_url GROUP BY 1",
    e="""SELECT jobs.*, unique_member_count, min(job_from) OVER (PARTITION BY company_url) AS first_year_cofound
      FROM jobs JOIN u USING (company_url) WHERE is_founder_or_owner_with_url AND unique_member_count BETWEEN 2 AND 9""")
add("profiles_extracted", "profiles experience", """
SELECT id, round(prob_female, 6) AS prob_female FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob_female NULLS FIRST) AS rn
FROM profiles WHERE id IN (SELECT member_id FROM experience)) WHERE rn = 1""")
add("profile_coverage", "profiles experience", """
SELECT count(*) AS wanted, count(*) FILTER (hit) AS found, round(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 6) AS coverage_pct
FROM (SELECT m, m IN (SELECT id FROM profiles) AS hit FROM (SELECT DISTINCT member_id AS m FROM experience WHERE member_id IS NOT NULL))""")
add("gender_probability", JOB_VIEWS + " profiles", """
SELECT linkedin_member_id, university_title, round(prob_female, 6) AS prob_female FROM person
LEFT JOIN (SELECT id, min(prob_female) AS prob_female FROM profiles GROUP BY 1) p ON id = linkedin_member_id""", **PERSON)

_CUT_P = _CUT
_MATH = fx.MAJORS[2][2]
_BEFORE_MATH = fx.MAJORS[0][2] + fx.MAJORS[1][2]
add("verification_sample", JOB_VIEWS, " UNION ALL ".join(f"""
(SELECT id, title, linkedin_member_id, university_title, university_major_clean, is_founder_or_owner_with_url, major_math
FROM r WHERE is_founder_or_owner_with_url = {b} ORDER BY md5('42:' || id), id, title NULLS FIRST, company_name NULLS FIRST LIMIT 100)""" for b in ("true", "false")),
    **PERSON,
    p=f"SELECT *, {_CUT} AS university_major_clean FROM person",
    r=f"""SELECT f.id, f.title, f.company_name, p.linkedin_member_id, university_title, university_major_clean, is_founder_or_owner_with_url,
      ((""" + " OR ".join(f"contains(lower(university_major_clean), {q(w)})" for w in _MATH) + ") AND NOT ("
      + " OR ".join(f"contains(lower(university_major_clean), {q(w)})" for w in _BEFORE_MATH)
      + f"""))::INT AS major_math FROM f JOIN p ON f.member_id = p.linkedin_member_id
      WHERE NOT coalesce(regexp_matches(university_major_clean, {q(fx.SHORT_NOTE)}), false)""")

# --- matching ---------------------------------------------------------------

_WORDS = "SELECT unnest(regexp_split_to_array(lower({c}), '\\s+')) AS word FROM {t}"
UNI = "SELECT * FROM universities WHERE instnm IN (SELECT instnm FROM universities GROUP BY 1 HAVING count(*) = 1)"
TAGS = f"""SELECT word FROM ({_WORDS.format(c='instnm', t='uni')}) WHERE length(word) > 3
  GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 10"""
add("tag_dictionary", "universities", f"""
(SELECT word, count(*) AS n, 'universities' AS source FROM ({_WORDS.format(c='instnm', t='uni')}) WHERE length(word) > 3
  GROUP BY 1 ORDER BY n DESC, word LIMIT 10)
UNION ALL (SELECT word, count(*) AS n, 'documents' FROM ({_WORDS.format(c='text', t='documents')}) WHERE length(word) > 3
  GROUP BY 1 ORDER BY n DESC, word LIMIT 10)""", uni=UNI)


def cleaned(c: str) -> str:
    """Found tags of a name, and the name with each of them cut out in order (list fold)."""
    tags = f"list_sort(list_filter((SELECT list(word) FROM tags), lambda w: contains(lower({c}), w)))"
    name = f"list_reduce(list_prepend(lower({c}), {tags}), lambda a, w: replace(a, w, ''))"
    return (
        f"coalesce(trim(regexp_replace({name}, '\\s+', ' ', 'g')), '') AS clean_name, "
        f"coalesce(array_to_string({tags}, ','), '') AS tags_str"
    )


add("clean_names", "universities education", f"SELECT name, {cleaned('name')} FROM (SELECT instnm AS name FROM uni UNION ALL SELECT DISTINCT title FROM education)",
    uni=UNI, tags=TAGS)

_SCORE = """CASE WHEN greatest(length(t.clean_name), length(u.clean_name)) = 0 THEN 100.0::DOUBLE
  ELSE (1.0::DOUBLE - levenshtein(t.clean_name, u.clean_name)::DOUBLE / greatest(length(t.clean_name), length(u.clean_name))) * 100.0::DOUBLE END"""
MATCHABLE = f"""SELECT * REPLACE (trim(lower(title)) AS title) FROM {{t}}
  WHERE school_url IS NOT NULL AND NOT suffix(school_url, {q(GENERIC_SUFFIX)})"""


def matches(rows: str, cutoff: int, per: str = "clean_name") -> dict[str, str]:
    return dict(
        u=f"SELECT unitid, instnm, {cleaned('instnm')} FROM uni",
        t=f"SELECT title, school_url, {cleaned('title')} FROM (SELECT DISTINCT title, school_url FROM {rows})",
        pairs=f"""SELECT t.title, t.school_url, t.clean_name, t.tags_str, u.unitid, u.instnm, u.clean_name AS clean_name_ua,
          {_SCORE} AS lev_score FROM t JOIN u USING (tags_str)""",
        best=f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {per} ORDER BY lev_score DESC, unitid, school_url, title) AS rn
          FROM pairs WHERE lev_score >= {cutoff}) WHERE rn = 1""",
    )


for _name, _per in (("fuzzy_match", "clean_name"), ("fuzzy_match_by_url", "school_url")):
    add(_name, "universities education", """
SELECT school_url, clean_name, tags_str, unitid, instnm, clean_name_ua, round(lev_score, 6) AS lev_score FROM best""",
        uni=UNI, tags=TAGS, rows=MATCHABLE.format(t="education"), **matches("rows", 70, _per))

_MATCHED = dict(
    uni=UNI, tags=TAGS, d=DATED_EDU,
    dated=MATCHABLE.format(t="(SELECT * FROM d WHERE year_from IS NOT NULL AND year_to BETWEEN 1991 AND 1997)"),
    **matches("dated", 85),
)
add("education_matched", "universities education", """
SELECT id, member_id, title, school_url, year_from, year_to, unitid, instnm FROM (
  SELECT *, row_number() OVER (PARTITION BY member_id, unitid ORDER BY id, title, subtitle NULLS FIRST, school_url, date_from, date_to) AS rn2
  FROM (SELECT * EXCLUDE (unitid) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY member_id, title, subtitle NULLS FIRST, school_url, date_from, date_to) AS rn
    FROM dated WHERE school_url IN (SELECT school_url FROM best)) WHERE rn = 1)
  JOIN (SELECT DISTINCT school_url, unitid, instnm FROM best) USING (school_url)) WHERE rn2 = 1""", **_MATCHED)
_STRICT = matches("rows", 85)
_LOOSE = {k + "2": v.replace("FROM t JOIN u", "FROM t2 t JOIN u2 u").replace("FROM pairs", "FROM pairs2")
          for k, v in matches("rows", 60, "school_url").items()}
add("units_assigned", "universities education", """
SELECT id, member_id, school_url, m.unitid, n.instnm
FROM (SELECT *, row_number() OVER (PARTITION BY member_id, m.unitid ORDER BY id, title, subtitle NULLS FIRST, school_url, date_from, date_to) AS rn
  FROM (SELECT * EXCLUDE (unitid) FROM rows) LEFT JOIN (SELECT school_url, unitid FROM best UNION SELECT school_url, unitid FROM best2) m USING (school_url)) m
LEFT JOIN uni n ON n.unitid = m.unitid WHERE rn = 1""",
    uni=UNI, tags=TAGS, rows=MATCHABLE.format(t="education"), **_STRICT, **_LOOSE)
add("url_decisions", "universities education", """
SELECT school_url, count(*) AS n_titles, school_url IN (SELECT school_url FROM best) AS accepted
FROM (SELECT DISTINCT title, school_url FROM rows) GROUP BY 1""",
    uni=UNI, tags=TAGS, rows=MATCHABLE.format(t="education"), **matches("rows", 85))
add("url_feed_rows", "universities education", "SELECT id, title, school_url FROM rows WHERE school_url IN (SELECT school_url FROM best)",
    uni=UNI, tags=TAGS, rows=MATCHABLE.format(t="education"), **matches("rows", 85, "school_url"))

REPEATS = """SELECT o.id, e.member_id, e.title, e.school_url, v.instnm
  FROM (SELECT o_custkey * 2 + o_orderkey % 2 AS id, o_custkey AS k FROM orders) o
  JOIN education e ON e.id = o.k JOIN universities v ON v.unitid = e.unitid"""
add("dup_education", "education universities", """
SELECT * FROM r WHERE member_id IN (SELECT member_id FROM r GROUP BY member_id, school_url HAVING count(*) > 1)""", r=REPEATS)
DISTANCES = dict(
    r=REPEATS,
    k="SELECT *, row_number() OVER (PARTITION BY id ORDER BY title NULLS FIRST, instnm NULLS FIRST) AS rn FROM r",
    x="""SELECT CASE WHEN rn = 1 THEN 'first' ELSE 'repeated' END AS kind, levenshtein(lower(title), lower(instnm)) AS d FROM k
      WHERE title IS NOT NULL AND instnm IS NOT NULL""",
)
add("dup_distances", "education universities", """
SELECT kind, count(*) AS n, round(avg(d), 6) AS mean_distance, round(median(d), 6) AS median_distance FROM x GROUP BY 1""", **DISTANCES)
add("dup_histogram", "education universities", """
SELECT kind, least(floor((d - lo) * 50.0 / nullif(hi - lo, 0)), 49)::INT AS bin, count(*) AS n
FROM (SELECT *, min(d) OVER (PARTITION BY kind) AS lo, max(d) OVER (PARTITION BY kind) AS hi FROM x) GROUP BY ALL""", **DISTANCES)
add("grad_counts", "education", """
SELECT 'year_to' AS kind, year_to AS year, count(*) AS n FROM clean_edu WHERE year_to BETWEEN 1988 AND 1996 GROUP BY ALL
UNION ALL SELECT 'year_from', year_from, count(*) FROM clean_edu WHERE year_from BETWEEN 1988 AND 1996 GROUP BY ALL""", clean_edu=CLEAN_EDU)
add("top_institutions", "education universities", """
(SELECT instnm, NULL::INTEGER AS year_to, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, instnm LIMIT 5)
UNION ALL (SELECT instnm, year_to, count(*) FROM x WHERE instnm = 'University of FRANCE' AND year_to IS NOT NULL GROUP BY ALL)""",
    clean_edu=CLEAN_EDU, x="SELECT c.*, instnm FROM clean_edu c JOIN universities USING (unitid)")

# --- entities ---------------------------------------------------------------


def normal(c: str) -> str:
    drop = ", ".join(q(t) for t in ["", *fx.DROP_TOKENS])
    return (
        f"nullif(array_to_string(list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), "
        f"lambda w: NOT list_contains([{drop}], w)), ' '), '')"
    )


ENT = dict(
    n=f"SELECT *, {normal('entity_name')} AS norm FROM entities_more",
    look="SELECT norm, min(entity_name) AS entity_name_matched FROM n WHERE norm IS NOT NULL GROUP BY 1",
    m=f"""SELECT e.*, entity_name_matched FROM (SELECT *, {normal('company_name')} AS company_name_norm FROM experience) e
      LEFT JOIN look ON company_name_norm = norm""",
    amb="SELECT norm, count(DISTINCT entity_name) AS n_names FROM n WHERE norm IS NOT NULL GROUP BY 1 HAVING count(DISTINCT entity_name) > 1",
    ty="""SELECT *, coalesce(company_name_norm IN (SELECT norm FROM amb), false) AS ambiguous_norm_key,
      CASE WHEN entity_name_matched IS NOT NULL AND lower(trim(company_name)) = lower(trim(entity_name_matched)) THEN 'matched_exact_ignore_case_space'
        WHEN entity_name_matched IS NOT NULL THEN 'matched_via_normalization_rules'
        WHEN company_name_norm IS NULL THEN 'unmatched_empty_normalized_name' ELSE 'unmatched_nonempty_normalized_name' END AS match_type FROM m""",
)
EV = "experience entities_more"
add("name_match", EV, "SELECT id, title, company_name, company_name_norm, entity_name_matched FROM m", **ENT)
add("name_match_rate", EV, """
SELECT count(*) AS n_rows, count(entity_name_matched) AS n_matched, round(count(entity_name_matched) / count(*)::DOUBLE, 6) AS match_rate FROM m""", **ENT)
add("match_types", EV, """
SELECT match_type, count(*) AS n_rows, round(count(*) / (SELECT count(*) FROM ty)::DOUBLE, 6) AS share FROM ty GROUP BY 1""", **ENT)
add("match_examples", EV, """
SELECT match_type, company_name, company_name_norm, entity_name_matched, ambiguous_norm_key, id FROM (
  SELECT *, row_number() OVER (PARTITION BY match_type ORDER BY id, company_name NULLS FIRST, company_name_norm NULLS FIRST, entity_name_matched NULLS FIRST) AS rn
  FROM ty) WHERE rn <= 10""", **ENT)
REPORT = """SELECT a.norm AS entity_name_norm, n_names, (SELECT string_agg(entity_name, '|' ORDER BY entity_name) FROM (
    SELECT DISTINCT entity_name FROM n WHERE n.norm = a.norm ORDER BY 1 LIMIT 10)) AS name_examples,
  (SELECT count(*) FROM ty WHERE company_name_norm = a.norm) AS experience_rows FROM amb a"""
add("ambiguous_keys", EV, REPORT, **ENT)
add("ambiguous_rows", EV, """
SELECT company_name_norm, company_name, entity_name_matched, id FROM (SELECT *, row_number() OVER (PARTITION BY company_name_norm
    ORDER BY id, company_name NULLS FIRST, entity_name_matched NULLS FIRST) AS rn
  FROM ty WHERE company_name_norm IN (SELECT entity_name_norm FROM rep ORDER BY experience_rows DESC, n_names DESC, entity_name_norm LIMIT 5))
WHERE rn <= 10""", **ENT, rep=REPORT)
add("normalised_words", "", f"SELECT conv_id, turn, md5({normal('text')}) AS norm FROM conversations")

# --- sets -------------------------------------------------------------------

add("natural_join", "", """
SELECT * FROM (SELECT l_orderkey AS k, l_linenumber, l_quantity FROM lineitem)
NATURAL JOIN (SELECT o_orderkey AS k, o_custkey, o_orderstatus FROM orders)""")
add("union_and_sets", "", """
SELECT d.doc_id, lang, quality, 1 + (quality IS NOT NULL)::INT AS n, CASE WHEN l.doc_id IS NULL THEN 'documents only' ELSE 'both' END AS status
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
add("many_files", "", """
SELECT c_custkey, c_name, NULL::BIGINT AS o_orderkey, NULL::VARCHAR AS o_orderstatus FROM customer
UNION ALL SELECT NULL, NULL, o_orderkey, o_orderstatus FROM orders""")
add("excluded_labels", "", """
SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
AND (lang IS NULL OR lang NOT IN ('en', 'de'))""")

# --- scores -----------------------------------------------------------------

add("entrepreneurs", "experience", "SELECT DISTINCT trim(company_name) AS company_name FROM f WHERE is_founder_or_owner AND trim(company_name) <> ''", f=FLAGGED)
add("outreach_sample", "experience company_scores", """
SELECT company_name, round(fb_ad_prob, 6) AS fb_ad_prob, fb_ad_likelihood, 1998 AS job_from FROM (
  SELECT DISTINCT company_name FROM f WHERE is_founder_or_owner AND job_from = 1998 AND company_name IS NOT NULL) x
LEFT JOIN s USING (company_name) ORDER BY md5('42:' || company_name) LIMIT 20""", f=FLAGGED, s=SCORED)
add("score_labels", "company_scores", "SELECT company_name, round(fb_ad_prob, 6) AS fb_ad_prob, fb_ad_likelihood FROM s", s=SCORED)
add("label_distribution", "company_scores", """
SELECT position, label, count(company_name) AS n, round(count(company_name) / (SELECT count(*) FROM s)::DOUBLE, 6) AS share
FROM (VALUES """ + ", ".join(f"({i + 1}, {q(x)})" for i, x in enumerate(fx.LABEL_ORDER)) + """) v(position, label)
LEFT JOIN s ON fb_ad_likelihood = label GROUP BY ALL""", s=SCORED)
_OVERRIDES = "SELECT regexp_replace(replace(entity_name, ', Inc.', ' Inc'), '^FIRM', 'Firm') AS company_name, coalesce([" + ", ".join(
    q(x) for x in fx.LABEL_ORDER) + "][length(entity_name) % 6 + 1], 'sure') AS label FROM entities"
add("overrides", "company_scores entities", f"""
SELECT s.company_name, round(fb_ad_prob, 6) AS fb_ad_prob, fb_ad_likelihood, coalesce(o.label, fb_ad_likelihood) AS fb_ad_likelihood_final
FROM s LEFT JOIN (SELECT * FROM o WHERE label IN ({', '.join(q(x) for x in fx.LABEL_ORDER)})) o USING (company_name)""", s=SCORED, o=_OVERRIDES)
add("override_problems", "company_scores entities", f"""
SELECT company_name, label, CASE WHEN label NOT IN ({', '.join(q(x) for x in fx.LABEL_ORDER)}) THEN 'invalid label' ELSE 'unknown company' END AS problem
FROM o WHERE label = 'sure' OR company_name NOT IN (SELECT company_name FROM company_scores)""", o=_OVERRIDES)
add("score_extremes", "company_scores", " UNION ALL ".join(f"""
(SELECT company_name, fb_ad_likelihood, round(fb_ad_prob, 6) AS fb_ad_prob, '{v}' AS view FROM s WHERE fb_ad_likelihood = {q(label)} ORDER BY {o}, company_name LIMIT 10)"""
    for v, label, o in [("top", "highly likely", "s.fb_ad_prob DESC"), ("bottom", "highly unlikely", "s.fb_ad_prob"),
                        ("nearest_half", "unclear", "abs(s.fb_ad_prob - 0.5)")]), s=SCORED)
add("validation_sample", "company_scores", """
SELECT company_name, round(fb_ad_prob, 6) AS fb_ad_prob, fb_ad_likelihood FROM (
  SELECT *, row_number() OVER (PARTITION BY fb_ad_likelihood ORDER BY md5('42:' || company_name)) AS rn FROM s WHERE fb_ad_likelihood IS NOT NULL) WHERE rn <= 5""", s=SCORED)
_TWO = """SELECT CASE quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS a, CASE toxic WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS b FROM labels"""
add("label_compare", "", "SELECT a AS model_said, b AS other_said, count(*) AS n FROM x WHERE b IS NOT NULL AND a IS DISTINCT FROM b GROUP BY ALL", x=_TWO)
add("label_agreement", "", """
SELECT count(*) AS n_total, count(*) FILTER (a = b) AS n_agree, count(*) FILTER (a IS DISTINCT FROM b) AS n_disagree,
  round(100.0::DOUBLE * count(*) FILTER (a = b) / count(*), 6) AS pct_agree FROM x WHERE b IS NOT NULL""", x=_TWO)
add("train_test_split", "experience", """
SELECT k, CASE WHEN rn <= 100 THEN 'train' ELSE 'test' END AS part FROM (
  SELECT k, row_number() OVER (ORDER BY md5('42:' || k), k) AS rn FROM (SELECT DISTINCT concat_ws('|', company_name, title) AS k FROM experience)) WHERE rn <= 200""")

# --- embeddings and classifiers ---------------------------------------------

_TOKENS = "SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS word FROM documents"
add("name_embedding", "", """
SELECT doc_id, pos, CASE WHEN v = 0 THEN 0.0::DOUBLE ELSE v END AS value  -- no negative zero
FROM (SELECT d.doc_id, pos, round(coalesce(total / k, 0), 6) AS v FROM (SELECT doc_id, unnest(range(64))::INT AS pos FROM documents WHERE text IS NOT NULL) d
LEFT JOIN (SELECT doc_id, i::INT AS pos, sum(n * x) AS total, sum(n) AS k FROM (
    SELECT doc_id, n, unnest(vec)::DOUBLE AS x, unnest(range(64)) AS i FROM (SELECT doc_id, word, count(*) AS n FROM t GROUP BY ALL) JOIN v USING (word))
  GROUP BY ALL) s USING (doc_id, pos))""",
    t=_TOKENS,
    v="""SELECT word, embedding AS vec FROM (SELECT word, ('0x' || substr(md5(word), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id
      FROM (SELECT DISTINCT word FROM t)) JOIN embeddings USING (vec_id)""")
add("normalised_embedding", "", """
SELECT vec_id, pos, CASE WHEN v = 0 THEN 0.0::DOUBLE ELSE v END AS value FROM (
  SELECT vec_id, pos, round(CASE WHEN len = 0 THEN x ELSE x / len END, 6) AS v FROM (
  SELECT vec_id, unnest(range(64))::INT AS pos, unnest(embedding)::DOUBLE AS x,
    sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) AS len FROM embeddings))""")
_TRAIN = """SELECT 'name ' || vec_id AS company_name, (label >= 5)::INT::DOUBLE AS y, unnest(range(64))::INT AS pos, unnest(embedding)::DOUBLE AS x
  FROM embeddings WHERE vec_id % 7 <> 0"""
add("aligned_training", "", "SELECT company_name, y, pos, round(x, 6) + 0.0::DOUBLE AS value FROM t WHERE y IS NOT NULL", t=_TRAIN)
add("standardised_features", "", """
SELECT company_name, pos, round(coalesce((x - avg(x) OVER p) / nullif(stddev_pop(x) OVER p, 0), 0), 6) + 0.0::DOUBLE AS value
FROM t WHERE y IS NOT NULL WINDOW p AS (PARTITION BY pos)""", t=_TRAIN)


def regressions(rows: str, iterations: int, dims: int = 64) -> dict[str, str]:
    """CTE ``fitted`` (model, w) for ``rows`` (model, x, y): accelerated gradient steps on half the squared weights plus
    the sum of losses, the intercept free.  The step size comes from the norm of the moment matrix."""
    zeros, n = f"list_resize([0.0::DOUBLE], {dims + 1}, 0.0::DOUBLE)", dims + 1
    gradient = ", ".join(f"sum(r * x[{j}])" for j in range(1, n + 1))
    return {
        "data": f"SELECT model, list_append(x, 1.0::DOUBLE) AS x, y FROM ({rows})",
        "moments": """SELECT model, sqrt(sum(g * g)) AS g FROM (SELECT model, i, j, sum(a * b) AS g
          FROM (SELECT model, y, unnest(x) AS a, unnest(range(len(x))) AS i, x FROM data), LATERAL (SELECT unnest(x) AS b, unnest(range(len(x))) AS j)
          GROUP BY model, i, j) GROUP BY model""",
        "steps": "SELECT model, 1 / (1 + g / 4) AS step, (sqrt(1 + g / 4) - 1) / (sqrt(1 + g / 4) + 1) AS pull FROM moments",
        "run": f"""SELECT model, 0 AS i, {zeros} AS w, {zeros} AS v FROM steps
          UNION ALL SELECT model, i + 1,
            list_transform(list_zip(new, v), lambda p: p[1] + pull * (p[1] - p[2])), new
          FROM (SELECT model, i, v, pull, list_transform(range(1, {n + 1}), lambda j: w[j] - step * (g[j] + CASE WHEN j < {n} THEN w[j] ELSE 0 END)) AS new
            FROM (SELECT model, i, any_value(w) AS w, any_value(v) AS v, [{gradient}] AS g
              FROM (SELECT run.model, i, w, v, x, 1 / (1 + exp(-list_dot_product(w, x))) - y AS r FROM run JOIN data USING (model) WHERE i < {iterations})
              GROUP BY model, i) JOIN steps USING (model))""",
        "fitted": f"SELECT model, v AS w FROM run WHERE i = {iterations}",
    }


def auc(rows: str, by: str = "what") -> str:
    """n_pos, n_neg and the AUC by mean ranks, per group of ``rows`` (group, s, y); scores are told apart to nine places."""
    return f"""SELECT {by}, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg,
      (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE)
        / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)) AS auc
      FROM (SELECT {by}, y, rank() OVER (PARTITION BY {by} ORDER BY s) + (count(*) OVER (PARTITION BY {by}, s) - 1) / 2.0::DOUBLE AS r FROM ({rows}))
      GROUP BY {by}"""


def recursive(name: str, body: str, **ctes: str) -> None:
    add(name, "", body, **ctes)
    ORACLE[name] = ORACLE[name].replace("WITH ", "WITH RECURSIVE ", 1)


NAMED = """SELECT 'name ' || vec_id AS company_name, vec_id, embedding::DOUBLE[] AS x,
  CASE WHEN vec_id % 7 <> 0 THEN (label >= 5)::INT::DOUBLE END AS y FROM embeddings"""
_MEANS = """SELECT list(m ORDER BY pos) AS m, list(CASE WHEN s = 0 THEN 1 ELSE s END ORDER BY pos) AS s
  FROM (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT unnest(x) AS x, unnest(range(64)) AS pos FROM named
    WHERE y IS NOT NULL AND vec_id % 5 <> 0) GROUP BY pos)"""
_SCALED = "list_transform(list_zip(x, m, s), lambda p: (p[1] - p[2]) / p[3])"
recursive("classifier", "SELECT what, n_pos, n_neg, round(auc, 3) AS auc FROM (" + auc("""
  SELECT CASE WHEN test THEN 'test' ELSE 'train' END || CASE model WHEN 'scaled' THEN ' scaled' ELSE '' END AS what, y,
    list_dot_product(w, list_append(x, 1.0::DOUBLE)) AS s FROM every JOIN fitted USING (model)""") + ")",
    named=NAMED, means=_MEANS,
    every=f"""SELECT 'plain' AS model, x, y, vec_id % 5 = 0 AS test FROM named WHERE y IS NOT NULL
      UNION ALL SELECT 'scaled', {_SCALED}, y, vec_id % 5 = 0 FROM named, means WHERE y IS NOT NULL""",
    **regressions("SELECT model, x, y FROM every WHERE NOT test", 700))
_FOLD = "('0x' || substr(md5(company_name), 1, 8))::BIGINT % 5"
recursive("cross_validation", "SELECT round(avg(auc), 3) AS auc_mean, round(stddev_pop(auc), 3) AS auc_sd FROM (" + auc(f"""
  SELECT model, y, list_dot_product(w, list_append(x, 1.0::DOUBLE)) AS s FROM named JOIN fitted ON model = {_FOLD} WHERE y IS NOT NULL""", "model") + ")",
    named=NAMED, **regressions(f"SELECT k AS model, x, y FROM named, (SELECT unnest(range(5)) AS k) WHERE y IS NOT NULL AND {_FOLD} <> k", 300))
recursive("name_scores", """
SELECT event_id, company_name, round(1 / (1 + exp(-list_dot_product(w, list_append(x, 1.0::DOUBLE)))), 3) AS prob_finance_broad
FROM (SELECT event_id, 'name ' || user_id AS company_name FROM events) LEFT JOIN named USING (company_name), fitted""",
    named=NAMED, **regressions("SELECT 0 AS model, x, y FROM named WHERE y IS NOT NULL", 400))
recursive("holdout_score", "SELECT n_pos, n_neg, round(auc, 3) AS auc FROM (" + auc("""
  SELECT 0 AS what, y, list_dot_product(w, list_append(x, 1.0::DOUBLE)) AS s FROM chosen, fitted WHERE y IS NOT NULL""") + ")",
    named=NAMED,
    chosen="SELECT * FROM named WHERE NOT (vec_id % 3 = 0 AND vec_id % 7 <> 0) ORDER BY md5('42:' || company_name) LIMIT 200",
    **regressions("SELECT 0 AS model, x, y FROM named WHERE y IS NOT NULL AND vec_id % 3 = 0", 300))
add("scored_rows", "", """
SELECT event_id, 'name ' || user_id AS company_name, user_id IN (SELECT vec_id FROM embeddings) AS scored FROM events""")
add("holdout_names", "", """
SELECT 'name ' || vec_id AS company_name FROM embeddings WHERE NOT (vec_id % 3 = 0 AND vec_id % 7 <> 0)
ORDER BY md5('42:' || 'name ' || vec_id) LIMIT 50""")
add("rank_auc", "", """
SELECT count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg,
  round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE)
    / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)), 6) AS auc
FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r
  FROM (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)) WHERE y IS NOT NULL AND s IS NOT NULL)""")

# --- labelling --------------------------------------------------------------

_NAMES = "SELECT DISTINCT concat_ws(' / ', company_name, title) AS company_name FROM experience"
add("label_batches", "experience", """
SELECT bucket, batch, count(*)::INT AS n_names, string_agg(company_name, '|' ORDER BY company_name) AS names FROM (
  SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY company_name) - 1) // 20 AS batch
  FROM (SELECT company_name, ('0x' || substr(md5(company_name), 1, 8))::BIGINT % 8 AS bucket FROM names)) GROUP BY bucket, batch""", names=_NAMES)
_LABEL = "CASE length(company_name) % 3 WHEN 0 THEN 'visual' WHEN 1 THEN 'non_visual' ELSE 'unknown' END AS label"
add("batch_labels", "experience", f"SELECT company_name, {_LABEL} FROM names", names=_NAMES)
add("resume_labels", "experience", f"SELECT company_name, {_LABEL}, 1 AS n_records FROM names", names=_NAMES)
add("label_lines", "", """
SELECT 'user ' || user_id AS company_name, event_type AS label, round(value, 6) AS confidence, NULL::VARCHAR AS reason
FROM events WHERE event_id % 4 = 3""")
add("reply_parse", "", """
SELECT k, CASE WHEN s = 3 THEN 'event ' || k WHEN s < 5 THEN 'user ' || user_id END AS company_name,
  CASE WHEN s < 5 THEN event_type END AS label, CASE WHEN s NOT IN (3, 5) THEN round(value, 6) END AS confidence
FROM (SELECT event_id AS k, event_id % 6 AS s, *, unnest(range(CASE WHEN event_id % 6 = 1 THEN 2 ELSE 1 END)) FROM events)
UNION ALL SELECT -conv_id * 100 - turn - 1, NULL, NULL, NULL FROM conversations""")

# --- finance ----------------------------------------------------------------

FIN = dict(
    d=DATED_EDU, f=FLAGGED, j=joined("f", "d", ["id", "company_name"]),
    fin="""SELECT j.*, fb_ad_prob AS pf, fb_ad_prob * fb_ad_prob AS pw FROM j LEFT JOIN company_scores USING (company_name)""",
    cells="""SELECT unitid, year_to, count(member_id) AS n_jobs, count(DISTINCT member_id) AS n_graduates, avg(pf) AS af, avg(pw) AS aw,
      avg(pf) * count(DISTINCT member_id) AS ef, avg(pw) * count(DISTINCT member_id) AS ew
      FROM fin WHERE job_from <= year_to + 2 GROUP BY ALL""",
)
FV = "experience education company_scores"
add("finance_school_year", FV, """
SELECT unitid, year_to, n_jobs, n_graduates, round(af, 6) AS avg_prob_finance_broad, round(aw, 6) AS avg_prob_wallstreet,
  round(ef, 6) AS est_count_finance_broad, round(ew, 6) AS est_count_wallstreet FROM cells""", **FIN)
add("finance_merged", FV, """
SELECT id_experience, id_education, fin.unitid, fin.year_to, n_jobs, n_graduates, round(af, 6) AS avg_prob_finance_broad,
  round(aw, 6) AS avg_prob_wallstreet, round(ef, 6) AS est_count_finance_broad, round(ew, 6) AS est_count_wallstreet
FROM fin LEFT JOIN cells ON fin.unitid IS NOT DISTINCT FROM cells.unitid AND fin.year_to IS NOT DISTINCT FROM cells.year_to""", **FIN)
add("finance_overall", FV, """
SELECT round(avg(af), 6) AS mean_finance_broad, round(avg(aw), 6) AS mean_wallstreet, round(sum(ef), 6) AS total_finance_broad,
  round(sum(ew), 6) AS total_wallstreet FROM cells""", **FIN)
add("finance_top_schools", FV, """
SELECT unitid, round(sum(ew), 6) AS est_count_wallstreet FROM cells WHERE unitid IS NOT NULL GROUP BY 1 ORDER BY sum(ew) DESC, unitid LIMIT 15""", **FIN)

# --- profiles ---------------------------------------------------------------

_ALL_EXP = ["id", *EXP]
_NULLS = " + ".join(f"({c} IS NULL)::INT" for c in _ALL_EXP)
add("profile_overview", "experience", f"""
SELECT metric, round(value::DOUBLE, 6) AS value FROM (
  SELECT 'rows' AS metric, count(*) AS value FROM experience UNION ALL SELECT 'columns', 7 UNION ALL SELECT 'columns of type bigint', 2
  UNION ALL SELECT 'columns of type string', 5
  UNION ALL SELECT 'empty_rows', count(*) FILTER ({_NULLS} = 7) FROM experience
  UNION ALL SELECT 'mostly_empty_rows', count(*) FILTER (({_NULLS}) / 7.0::DOUBLE > 0.2) FROM experience
  UNION ALL SELECT 'completeness_pct', (count(*) * 7 - sum({_NULLS})) * 100.0::DOUBLE / (count(*) * 7) FROM experience)""")
add("profile_missing", "experience", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS pct_missing FROM experience"
    for c in _ALL_EXP))
_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
add("profile_numeric", "", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 8) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min,
  max({c})::DOUBLE AS max, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75 FROM lineitem"""
    for c in _NUM))
add("profile_extras", "", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", round(var_samp({c}), 2) AS variance, round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis,
  round(median({c}), 6) AS median, (SELECT {c}::DOUBLE FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode FROM lineitem"""
    for c in _NUM))
_TXT = ["title", "company_name", "company_url", "date_from", "date_to"]
add("profile_categorical", "experience", " UNION ALL ".join(f"""
(SELECT '{c}' AS "column", count(*) OVER () AS n_unique, {c} AS most_frequent, n AS most_frequent_count,
  round(n * 100.0::DOUBLE / (SELECT count(*) FROM experience), 6) AS most_frequent_pct
FROM (SELECT {c}, count(*) AS n FROM experience WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, {c} LIMIT 1)""" for c in _TXT))
add("profile_binary", "", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) FILTER ({e} = 1) AS n_true, count(*) FILTER ({e} = 0) AS n_false,
  round(count(*) FILTER ({e} = 1) * 100.0::DOUBLE / count(*), 6) AS pct_true FROM labels""" for c, e in [("quality", "quality"), ("toxic", "toxic"), ("flag", "quality"), ("real", "toxic"), ("exact", "toxic")]))
add("profile_column_groups", "experience", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", 'entrepreneurship' AS column_group, count(*) AS n_rows, count({c}) AS n_known, count(*) FILTER ({c}) AS n_true, "
    f"round(avg({c}::INT), 6) AS share_true FROM f" for c in FLAG_COLS[2:]), f=FLAGGED)
add("profile_keys", "experience", f"""
SELECT (SELECT count(*) FROM experience) - (SELECT count(*) FROM (SELECT DISTINCT * FROM experience)) AS n_duplicates,
  round(((SELECT count(*) FROM experience) - (SELECT count(*) FROM (SELECT DISTINCT * FROM experience))) * 100.0::DOUBLE / (SELECT count(*) FROM experience), 6) AS pct_duplicates,
  count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(*) - count(DISTINCT id) AS n_surplus FROM experience""")
add("quality_metrics", "education experience", """
SELECT metric, round(value, 6) AS value FROM (
  SELECT 'education_rows' AS metric, count(*)::DOUBLE AS value FROM clean_edu
  UNION ALL SELECT 'education_members', count(DISTINCT member_id) FROM clean_edu
  UNION ALL SELECT 'year_to_min', min(year_to) FROM clean_edu UNION ALL SELECT 'year_to_max', max(year_to) FROM clean_edu
  UNION ALL SELECT 'experience_rows', count(*) FROM f UNION ALL SELECT 'company_name_missing', count(*) - count(company_name) FROM f
  """ + " ".join(f"UNION ALL SELECT 'mean_{c}', avg({c}::INT) FROM f" for c in
                 ["is_founder_only", "is_owner_only", "is_founder_or_owner", "is_founder_or_owner_with_url"]) + ")",
    clean_edu=CLEAN_EDU, f=FLAGGED)
add("top_companies", "experience", "SELECT company_name, count(*) AS n FROM experience WHERE company_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, company_name LIMIT 20")
add("binary_to_int", "", """
SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic, quality::BIGINT AS as_double, (toxic = 1)::BIGINT AS as_flag, quality * 2 AS other FROM labels""")
_PLAIN = ["bachelors_degree", *WINDOW_NAMES, *[f"major_{name}" for _, name, _ in fx.MAJORS], "major_other"]
_LABELS = {**fx.PANEL_LABELS, "no_such_column": "A label without a column"}
add("label_coverage", JOB_VIEWS, " UNION ALL ".join(
    (f"SELECT '{c}' AS \"column\", count({'university_major_clean' if c == 'university_major_categorized' else c}) AS n_known, {q(t)} AS label, 'labelled' AS status FROM p"
     if c != "no_such_column" else f"SELECT '{c}', NULL, {q(t)}, 'label without column'") for c, t in _LABELS.items())
    + "".join(f" UNION ALL SELECT '{c}', count({c if c in WINDOW_NAMES else '*'}), NULL, 'column without label' FROM p" for c in _PLAIN),
    **PERSON, p=f"SELECT * FROM (SELECT *, {_CUT} AS university_major_clean FROM person) WHERE NOT coalesce(regexp_matches(university_major_clean, {q(fx.SHORT_NOTE)}), false)")
add("labelled_dictionary", "experience", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {label} AS label, count({c}) AS n_known FROM experience"
    for c, label in [("id", "'Number of the job'"), ("company_url", "'Page of the employer'"),
                     *[(c, "NULL::VARCHAR") for c in ("member_id", "title", "company_name", "date_from", "date_to")]]))

# --- sources, sinks, stages -------------------------------------------------

add("csv_round_trip", "experience", "SELECT id, company_name, title, how FROM experience, (VALUES ('typed'), ('tolerant'), ('inferred')) v(how)")
add("size_capped_write", "", "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, 0 AS parts_over_cap FROM lineitem")
add("dated_versions", "", "SELECT o_orderkey, o_orderstatus FROM orders")
_CATEGORY = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(university_major_clean), {q(w)})" for w in words) + f" THEN {q(label)}"
    for label, _, words in fx.MAJORS) + " ELSE 'Other' END"
add("stage_resume", JOB_VIEWS, f"""
SELECT linkedin_member_id, unitid, year_end_college, {_CATEGORY} AS university_major_categorized,
  is_founder_or_owner_3_years_o, is_founder_or_owner_5_years_p, 0 AS idle_stages
FROM (SELECT *, {_CUT} AS university_major_clean FROM person) WHERE NOT coalesce(regexp_matches(university_major_clean, {q(fx.SHORT_NOTE)}), false)""", **PERSON)
