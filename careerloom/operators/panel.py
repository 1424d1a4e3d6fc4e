"""Careers joined to graduations, and the person-level panel."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerloom.functions import fixed_values as fx
from careerloom.operators.education import bachelors_flag, categorise_major, clean_major
from careerloom.operators.relational import (
    Skew,
    broadcast_by_size,
    columns_like,
    enrich,
    flag_in_keys,
    in_keys,
    keep_first,
    measure_skew,
    rename,
    sample_candidates,
    sample_n,
)
from careerloom.operators.titles import work_role_flags
from careerloom.session import stored, stored_by


#: Member ids that are sent to every task, at most: about 100 MB.
MEMBERS = 4_000_000


def restrict_experience(exp: DataFrame, edu: DataFrame) -> DataFrame:
    """Experience of members with an education record, one row per id.

    Only ids are moved to look for those of several rows, whose first row is
    chosen then; all other rows stay where they are.
    """
    kept = stored(of_members(exp, edu, "member_id"), "members-experience")
    counts = kept.groupBy("id").agg(F.count("*").alias("_n"))
    return _first_of(kept, stored(counts.where("_n > 1").select("id"), "repeated-ids"))


def ids_within_members(exp: DataFrame, edu: DataFrame) -> DataFrame:
    """Experience of members with an education record, stored; rows that share an id share their member.

    ``restrict_experience`` without its last step inside a member, which
    ``first_of_id`` does where the member's rows are together anyway.  Only ids
    and members are moved to look for ids of several members; the first row of
    those ids is chosen here.
    """
    kept = stored(of_members(exp, edu, "member_id"), "members-experience")
    ends = kept.groupBy("id").agg(F.min("member_id").alias("_least"), F.max("member_id").alias("_most"))
    crossing = stored(ends.where("_least <> _most").select("id"), "crossing-ids")
    chosen = _first_of(kept, crossing)
    return kept if chosen is kept else stored(chosen, "base-experience")


def _first_of(kept: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows, but of the listed ids, and of rows without an id if any is listed, the first one only."""
    if ids.isEmpty():
        return kept
    if not broadcast_by_size(ids):
        return keep_first(kept, "id")
    marked = flag_in_keys(kept, ids, "id", "_listed").withColumn("_listed", F.col("_listed") | F.col("id").isNull())
    others, listed = (marked.where(F.col("_listed") == is_in).select(*kept.columns) for is_in in (False, True))
    return others.unionByName(keep_first(listed, "id"))


def first_of_id(jobs: DataFrame) -> DataFrame:
    """First row per id of rows whose ids stay within a member."""
    return keep_first(jobs, ["member_id", "id"])


def of_members(df: DataFrame, members: DataFrame, on: str) -> DataFrame:
    """Rows whose member is in the other table: the member ids go to every task while they are at most ``MEMBERS``."""
    known = stored(members.select(on).where(F.col(on).isNotNull()).distinct(), "members")
    if known.count() > MEMBERS:
        return in_keys(df, known, on)
    return df.join(F.broadcast(known), on, "left_semi").select(*df.columns)


def _renamed(df: DataFrame, other: DataFrame, suffix: str) -> DataFrame:
    shared = (set(df.columns) & set(other.columns)) - {"member_id"}
    return df.withColumnsRenamed({c: c + suffix for c in shared})


def _of_hot_members(jobs: DataFrame, degrees: DataFrame, pieces: int) -> DataFrame:
    """The join for members with very many jobs: the jobs are cut into pieces, and each degree meets every piece."""
    cut = jobs.withColumn("_piece", F.pmod(F.xxhash64(*jobs.columns), F.lit(pieces)).cast("int"))
    every = degrees.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return cut.join(every, ["member_id", "_piece"]).drop("_piece")


def join_experience_education(
    exp: DataFrame, edu: DataFrame, skew: Skew | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Every job of a member beside every degree, repeats on nine columns dropped.

    The nine columns split into five of the job and four of the degree, so the
    repeats can be dropped on each side before the join with the same result;
    the join then never multiplies duplicates by duplicates.  Both sides are
    stored in buckets of the member, which the five and the four contain: one
    shuffle a side, and none for dropping repeats or joining.  Members that
    hold more than a small share of the jobs (``skew``; measured if not given)
    stay out of the buckets: their repeats are dropped by all key columns, and
    their jobs are cut into pieces.  ``prepare`` makes the jobs of stored rows,
    so that only what it starts from is moved; it may look at one member's rows
    at a time.
    """
    known = F.col("member_id").isNotNull()
    skew = skew or measure_skew(exp.where(known), "member_id")
    hot = F.col("member_id").isin(*skew.values)
    ready = prepare or (lambda rows: rows)
    dealt = ready(stored_by(exp.where(known & ~hot), "member_id", "jobs"))
    jobs, degrees = _renamed(dealt, edu, "_experience"), _renamed(edu, dealt, "_education")
    job_keys, degree_keys = (
        [k for k in keys if k in side.columns] for keys, side in zip(fx.JOB_EDUCATION_KEYS, (jobs, degrees))
    )
    first_degree = keep_first(stored_by(degrees.where(known & ~hot), "member_id", "degrees"), degree_keys)
    joined = keep_first(jobs, job_keys).join(first_degree, "member_id")
    if not skew.found:
        return joined
    hot_jobs = keep_first(_renamed(ready(exp.where(hot)), edu, "_experience"), job_keys)
    hot_degrees = keep_first(degrees.where(hot), degree_keys)
    return joined.unionByName(_of_hot_members(hot_jobs, hot_degrees, skew.pieces))


def flag_columns(df: DataFrame, of: DataFrame | None = None) -> list[str]:
    """Boolean columns about founding or owning, with the two work roles first."""
    names = columns_like(of if of is not None else df, ["found", "own"], boolean_only=True)
    return [c for c in ["worked_as_engineer", "worked_in_sales", *names] if c in df.columns]


def time_window_flags(panel: DataFrame, cols: Sequence[str], years: Sequence[int] = fx.WINDOW_YEARS) -> DataFrame:
    """``<flag>_<n>_years_o`` and ``_p``.

    ``_o``: the job began within n years of graduation.  ``_p``: the same with
    the founding year of the company page, where it is known; without a column
    of these years there is no ``_p``.  A job without a start counts as outside;
    a degree without an end year leaves a set flag null.
    """
    starts = {"o": F.col("job_from")}
    if "company_page_founded_year" in panel.columns:
        starts["p"] = F.coalesce("company_page_founded_year", "job_from")
    tests = {
        f"{n}_years_{kind}": F.when(year.isNull(), F.lit(False)).otherwise(year <= F.col("year_to") + n)
        for n in years
        for kind, year in starts.items()
    }
    held = panel.withColumns({f"_{name}": test for name, test in tests.items()})
    flags = {f"{c}_{name}": F.col(c) & F.col(f"_{name}") for c in cols for name in tests}
    return held.withColumns(flags).drop(*[f"_{name}" for name in tests])


def job_level(
    exp: DataFrame, edu: DataFrame, years: Sequence[int] = fx.WINDOW_YEARS, skew: Skew | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Job x degree rows with work roles and window flags."""
    joined = work_role_flags(join_experience_education(exp, edu, skew, prepare))
    return time_window_flags(joined, flag_columns(joined, prepare(exp) if prepare else exp), years)


def collapse_to_person(panel: DataFrame) -> DataFrame:
    """One row per member and degree: any of the window flags, mean of the probabilities.

    Null keys form groups.  Boolean maxima and means combine on the map side,
    so a member with many rows costs one row per task.
    """
    flags = [c for c in panel.columns if c.endswith(("_years_o", "_years_p"))]
    means = [c for c in ("avg_prob_finance_broad", "avg_prob_wallstreet") if c in panel.columns]
    person = panel.groupBy(*fx.PERSON_KEYS).agg(
        *[F.max(c).alias(c) for c in flags], *[F.avg(c).alias(c) for c in means]
    )
    return rename(person, fx.PERSON_NAMES)


def with_majors(person: DataFrame) -> DataFrame:
    """Degree flag, cleaned major and category columns on the person panel."""
    return categorise_major(clean_major(bachelors_flag(person)))


def extract_member_profiles(profiles: DataFrame, ids: DataFrame, on: str = "member_id") -> DataFrame:
    """Profiles of the wanted members, one per id."""
    return keep_first(in_keys(profiles, ids, "id", on), "id")


def profile_coverage(profiles: DataFrame, ids: DataFrame, on: str = "member_id") -> DataFrame:
    """Wanted members, members found and the share found."""
    wanted = ids.select(F.col(on).alias("id")).where(F.col("id").isNotNull()).distinct()
    found = profiles.select("id").where(F.col("id").isNotNull()).distinct().withColumn("_found", F.lit(True))
    both = wanted.join(found, "id", "left")
    return both.agg(F.count("*").alias("wanted"), F.count("_found").alias("found")).withColumn(
        "coverage_pct", F.try_divide(F.col("found") * 100.0, F.col("wanted"))
    )


def add_gender_probability(person: DataFrame, profiles: DataFrame) -> DataFrame:
    """One profile attribute beside each person (C50): the smallest one known, where profiles share an id."""
    one = profiles.groupBy(F.col("id").alias("linkedin_member_id")).agg(F.min("prob_female").alias("prob_female"))
    return enrich(person, one, "linkedin_member_id")


def verification_sample(exp: DataFrame, person: DataFrame, n: int = 10_000, seed: int = 42) -> DataFrame:
    """n with-URL founder rows and n other rows beside their panel row, for human review.

    Every job of a member of the panel gives a row or more, so the first n jobs
    of a kind hold its first n rows: only those few meet the panel.
    """
    people = person.withColumn("member_id", F.col("linkedin_member_id"))
    jobs = of_members(exp, people, "member_id")
    founder = F.col("is_founder_or_owner_with_url")
    near = [sample_candidates(jobs.where(kind), n, "id", seed) for kind in (founder, ~founder)]
    joined = stored(near[0].unionByName(near[1]), "candidates").join(people, "member_id")
    majors = [c for c in person.columns if "major" in c and c != "university_major_raw"]
    cols = ["id", "title", "company_name", "company_url", "linkedin_member_id", "university_title",
            "university_major_raw", "is_founder_or_owner_with_url", *majors]
    rows = joined.select(*[c for c in cols if c in joined.columns])
    flag = F.col("is_founder_or_owner_with_url")
    return sample_n(rows.where(flag), n, "id", seed).unionByName(sample_n(rows.where(~flag), n, "id", seed))


def members_with_education(members: DataFrame, edu: DataFrame) -> DataFrame:
    """Member profiles beside each of their education records."""
    right = edu.withColumnsRenamed({c: c + "_education" for c in edu.columns if c in members.columns})
    return members.join(right, members["id"] == right["member_id"])


def member_counts(members: DataFrame, edu: DataFrame) -> DataFrame:
    """Distinct members in each table and in their join."""
    a = members.select(F.col("id").alias("m"), F.lit(1).alias("in_members"), F.lit(0).alias("in_education"))
    b = edu.select(F.col("member_id").alias("m"), F.lit(0).alias("in_members"), F.lit(1).alias("in_education"))
    per_member = a.unionByName(b).where(F.col("m").isNotNull()).groupBy("m").agg(
        F.max("in_members").alias("p"), F.max("in_education").alias("e")
    )
    return per_member.agg(
        F.sum("p").alias("members"), F.sum("e").alias("education_members"),
        F.sum(F.col("p") * F.col("e")).alias("members_with_education"),
    )
