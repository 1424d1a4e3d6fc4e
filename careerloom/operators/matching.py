"""School matching: tag dictionary, block keys, edit-distance join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerloom.functions import fixed_values as fx
from careerloom.functions.ranks import exact_percentiles
from careerloom.functions.text import edit_distance, strip, tags_in, tokens, without_tags
from careerloom.operators.relational import enrich, in_keys, keep_first, repeat_counts


def word_counts(df: DataFrame, text: str, longer_than: int = 3) -> DataFrame:
    """Frequency of the lower-cased words longer than ``longer_than``."""
    words = df.select(F.explode(tokens(F.lower(text))).alias("word")).where(F.length("word") > longer_than)
    return words.groupBy("word").agg(F.count("*").alias("n"))


def tag_dictionary(universities: DataFrame, k: int = 10, name: str = "instnm") -> DataFrame:
    """The k most frequent longer words of the institution names (C1); ties go by word."""
    return word_counts(universities, name).orderBy(F.desc("n"), "word").limit(k)


def tag_list(universities: DataFrame, k: int = 10) -> list[str]:
    """The tag words on the driver: k words, whatever the size of the table."""
    return [r.word for r in tag_dictionary(universities, k).collect()]


def clean_names(df: DataFrame, name: str, tags: list[str]) -> DataFrame:
    """Tags found in the name, the name without them, and the block key."""
    found = tags_in(name, tags)
    return df.withColumns({
        "tags": found,
        "clean_name": without_tags(name, tags),
        "tags_str": F.array_join(found, ","),
    })


def _best_by_name(universities: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """Best university per distinct (tags_str, clean_name).

    Two names can only reach the cutoff when their lengths are close, so each
    university is listed under every length it can match, and the join is an
    equi-join on block and length: the empty-tag block, which may hold most
    names, is cut by length.  The distance itself stops at the largest
    distance the cutoff allows.  Spark broadcasts the university side if it
    measures small; otherwise both sides are plain shuffles, whose hot blocks
    AQE splits.
    """
    if not 0 < cutoff <= 100:
        raise ValueError("the cutoff is a score above 0, at most 100")
    c = cutoff / 100.0
    size = F.length("clean_name")
    slack = 1e-9
    reach = F.sequence(F.ceil(size * F.lit(c) - slack).cast("int"), F.floor(size / F.lit(c) + slack).cast("int"))
    listed = universities.select(
        "unitid", "instnm", F.col("clean_name").alias("clean_name_ua"), "tags_str", F.explode(reach).alias("n_chars")
    )
    wanted = names.withColumn("n_chars", size)
    longer = "greatest(length(clean_name), length(clean_name_ua))"
    allowed = f"cast(floor({1 - c} * {longer} + {slack}) as int)"
    scored = wanted.join(listed, ["tags_str", "n_chars"]).withColumn(
        "_d", F.expr(f"levenshtein(clean_name, clean_name_ua, {allowed})")
    ).where("_d >= 0").withColumn(
        "lev_score",
        F.expr(f"case when {longer} = 0 then 100D else (1D - _d / {longer}) * 100D end"),
    )
    good = scored.where(F.col("lev_score") >= cutoff).select(
        "tags_str", "clean_name", "unitid", "instnm", "clean_name_ua", "lev_score"
    )
    return keep_first(good, ["tags_str", "clean_name"], [F.desc("lev_score"), F.asc("unitid")])


def fuzzy_match(
    universities: DataFrame | None,
    titles: DataFrame | None,
    tags: list[str],
    cutoff: float = 70,
    per: str = "clean_name",
) -> DataFrame | None:
    """Best university for each cleaned school title, at or above the cutoff (C4).

    ``titles`` has ``title`` and ``school_url``.  ``per='clean_name'`` keeps one
    row, hence one URL, per cleaned name; ``per='school_url'`` keeps the best
    row of every URL.  Names are matched once however many URLs carry them.
    """
    if universities is None or titles is None:
        return None
    dim = clean_names(universities, "instnm", tags)
    named = clean_names(titles, "title", tags).select("title", "school_url", "tags_str", "clean_name")
    best = _best_by_name(dim, named.select("tags_str", "clean_name").distinct(), cutoff)
    order = [F.desc("lev_score"), F.asc("unitid"), F.asc("school_url"), F.asc("title")]
    if per == "clean_name":
        # rows of one (tags, name) pair share their candidates: only the first URL can win
        first = named.groupBy("tags_str", "clean_name").agg(
            F.min(F.struct("school_url", "title")).alias("_first")
        ).select("tags_str", "clean_name", "_first.*")
        return keep_first(first.join(best, ["tags_str", "clean_name"]), "clean_name", order)
    if per == "school_url":
        # a common name may stand under very many URLs; neither part holds a line break
        name = F.concat_ws("\n", "tags_str", "clean_name").alias("_name")
        answers = best.select(name, *[c for c in best.columns if c not in ("tags_str", "clean_name")])
        scored = enrich(named.select("*", name), answers, "_name", how="inner").drop("_name")
        return keep_first(scored, "school_url", order)
    raise ValueError("per is 'clean_name' or 'school_url'")


def matchable(edu: DataFrame, generic_suffix: str = fx.GENERIC_SCHOOL_URL_SUFFIX) -> DataFrame:
    """Rows with a real school URL, titles lower-cased and trimmed."""
    return edu.where(F.col("school_url").isNotNull() & ~F.col("school_url").endswith(generic_suffix)).withColumn(
        "title", strip(F.lower("title"))
    )


def school_matches(
    edu: DataFrame, universities: DataFrame, tags: list[str], cutoff: float = fx.MATCH_CUTOFF, per: str = "clean_name"
) -> DataFrame:
    """Fuzzy matches of the distinct (title, URL) pairs of matchable rows."""
    return fuzzy_match(universities, edu.select("title", "school_url").distinct(), tags, cutoff, per)


def match_education(
    edu: DataFrame,
    universities: DataFrame,
    tags: list[str],
    cutoff: float = fx.MATCH_CUTOFF,
    per: str = "clean_name",
    generic_suffix: str = fx.GENERIC_SCHOOL_URL_SUFFIX,
) -> DataFrame:
    """Education rows whose school URL matched a university, with its id and name.

    A URL carries the list of its universities (no longer than the reference
    list), so one lookup both filters the rows and brings the ids; one row per
    id is chosen before the list is spread out, one per member and university after.
    """
    rows = matchable(edu, generic_suffix).drop("unitid", "instnm")
    units = school_matches(rows, universities, tags, cutoff, per).groupBy("school_url").agg(
        F.array_sort(F.collect_set(F.struct("unitid", "instnm"))).alias("_units")
    )
    one_per_id = keep_first(enrich(rows, units, "school_url", how="inner"), "id")
    spread = one_per_id.select("*", F.explode("_units").alias("_u")).select(*rows.columns, "_u.unitid", "_u.instnm")
    return keep_first(spread, ["member_id", "unitid"])


def assign_unit_id(rows: DataFrame, *url_maps: DataFrame) -> DataFrame:
    """Join the distinct complete (school_url, unitid) pairs of the maps, one row per member and unit."""
    pairs = url_maps[0].select("school_url", "unitid")
    for more in url_maps[1:]:
        pairs = pairs.unionByName(more.select("school_url", "unitid"))
    return keep_first(enrich(rows, pairs.na.drop().distinct(), "school_url"), ["member_id", "unitid"])


def add_institution_name(df: DataFrame, universities: DataFrame) -> DataFrame:
    """Institution name by unit id."""
    return enrich(df, universities.select("unitid", "instnm"), "unitid")


def url_decisions(
    edu: DataFrame, universities: DataFrame, tags: list[str], cutoff: float = fx.MATCH_CUTOFF,
    generic_suffix: str = fx.GENERIC_SCHOOL_URL_SUFFIX,
) -> DataFrame:
    """Accept or reject every school URL once (I2, batch form): independent of row order."""
    pairs = matchable(edu, generic_suffix).select("title", "school_url").distinct()
    accepted = fuzzy_match(universities, pairs, tags, cutoff).select("school_url").distinct().withColumn("_hit", F.lit(True))
    per_url = pairs.groupBy("school_url").agg(F.count("*").alias("n_titles"))
    return per_url.join(accepted, "school_url", "left").select(
        "school_url", "n_titles", F.coalesce(F.col("_hit"), F.lit(False)).alias("accepted")
    )


def duplicate_education_report(matched: DataFrame) -> DataFrame:
    """All rows of the members who have one school twice."""
    twice = matched.groupBy("member_id", "school_url").agg(F.count("*").alias("n")).where("n > 1")
    return in_keys(matched, twice, "member_id")


def _distance_counts(matched: DataFrame, key: str) -> DataFrame:
    """Rows per (first or repeated row of the key, title-to-institution distance)."""
    counted = repeat_counts(matched.select(key, "title", "instnm"), key)
    return (
        counted.withColumn("d", edit_distance("title", "instnm").cast("double"))
        .where(F.col("d").isNotNull())
        .select("d", F.col("repeats").alias("repeated"), (F.col("copies") - F.col("repeats")).alias("first"))
        .unpivot("d", ["first", "repeated"], "kind", "n")
        .groupBy("kind", "d")
        .agg(F.sum("n").alias("n"))
        .where("n > 0")
    )


def name_distances(matched: DataFrame, key: str = "id") -> DataFrame:
    """Count, mean and exact median of the title-to-institution distance, for the first and
    the repeated rows of a key (C52, W4)."""
    counts = _distance_counts(matched, key)
    stats = counts.groupBy("kind").agg(
        F.sum("n").alias("n"), (F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("mean_distance")
    )
    median = exact_percentiles(counts, "kind", "d", [0.5], weight="n")
    return stats.join(median.select("kind", F.col("value").alias("median_distance")), "kind")


def distance_histogram(matched: DataFrame, key: str = "id", bins: int = 50) -> DataFrame:
    """Equal-width bins of the same distances (A19); the last bin is closed on both sides."""
    counts = _distance_counts(matched, key)
    ends = F.broadcast(counts.groupBy("kind").agg(F.min("d").alias("lo"), F.max("d").alias("hi")))  # two rows
    at = F.floor((F.col("d") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))
    return (
        counts.join(ends, "kind")
        .withColumn("bin", F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(at, F.lit(bins - 1))).cast("int"))
        .groupBy("kind", "bin")
        .agg(F.sum("n").alias("n"))
    )
