"""The staged build: every stage reads what the stage before stored.

Within a stage the operators build lazy plans; a table that several of them
read is stored beside the stages' own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from careerloom.operators.companies import founding_year, merge_company_scores, shrink
from careerloom.operators.education import clean_education, with_years
from careerloom.operators.ownership import (
    cofounder_events,
    cofounder_flags,
    employee_before_founder_filter,
    franchise_flags,
)
from careerloom.operators.panel import collapse_to_person, job_level, restrict_experience, with_majors
from careerloom.operators.titles import dated, founder_owner_flags
from careerloom.session import stored
from careerloom.sources.readers import exists, snapshot

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """``make`` gets the sources and all tables stored so far; its tables are stored under its name."""

    name: str
    makes: tuple[str, ...]
    make: Callable[[Tables], Tables]


def _analysis_files(t: Tables) -> Tables:
    education = with_years(clean_education(t["education"].distinct(), t["_suffix"]))
    return {"education_clean": education, "experience_base": restrict_experience(t["experience"], education)}


def _flags(t: Tables) -> Tables:
    # stored, as the company counts, the URL counts and the rows themselves are read from it
    titled = stored(shrink(founder_owner_flags(dated(t["experience_base"]))), "titled")
    return {"experience_flagged": merge_company_scores(cofounder_flags(franchise_flags(titled)), t.get("company_scores"))}


def _founding(t: Tables) -> Tables:
    return {"experience_dated": founding_year(t["experience_flagged"], t.get("companies"), t["_host"])}


def _precedence(t: Tables) -> Tables:
    return {"experience_final": employee_before_founder_filter(t["experience_dated"])}


def _panel(t: Tables) -> Tables:
    return {"job_level": job_level(t["experience_final"], t["education_clean"])}


def _person(t: Tables) -> Tables:
    return {"person": with_majors(collapse_to_person(t["job_level"]))}


def _cofounders(t: Tables) -> Tables:
    return {"cofounder_events": cofounder_events(t["job_level"])}


STAGES = [
    Stage("analysis_files", ("education_clean", "experience_base"), _analysis_files),
    Stage("flags", ("experience_flagged",), _flags),
    Stage("founding", ("experience_dated",), _founding),
    Stage("precedence", ("experience_final",), _precedence),
    Stage("job_level", ("job_level",), _panel),
    Stage("person", ("person",), _person),
    Stage("cofounders", ("cofounder_events",), _cofounders),
]


def run(
    spark: SparkSession,
    sources: Tables,
    root: str,
    start: int | str = 1,
    redo: bool = True,
    host: str = "linkedin.com",
    generic_suffix: str = "linkedin.com/edu/school",
) -> list[str]:
    """Run the stages from ``start`` on (number from 1, or name); returns the names of those that ran.

    With ``redo=False`` a stage whose tables are all stored is skipped.
    """
    names = [s.name for s in STAGES]
    first = names.index(start) if isinstance(start, str) else start - 1
    if not 0 <= first < len(STAGES):
        raise ValueError(f"start is 1..{len(STAGES)} or one of {names}")
    ran = []
    for i, stage in enumerate(STAGES):
        paths = {m: f"{root}/{m}" for m in stage.makes}
        if i < first or (not redo and all(exists(spark, p) for p in paths.values())):
            continue
        done = {m: snapshot(spark, f"{root}/{m}") for s in STAGES[:i] for m in s.makes if exists(spark, f"{root}/{m}")}
        for name, table in stage.make({**sources, **done, "_host": host, "_suffix": generic_suffix}).items():
            table.write.mode("overwrite").parquet(paths[name])
        ran.append(stage.name)
    return ran
