"""Company scores: labels, samples, comparison, overrides."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerloom.functions import fixed_values as fx
from careerloom.functions.text import probability_label
from careerloom.operators.relational import enrich, first_k, keep_columns, keep_first, sample_n, seeded, share


def label_rank(label: Column | str) -> Column:
    """Position of a label in the fixed order, 1 = most likely."""
    return F.array_position(F.array(*[F.lit(x) for x in fx.LABEL_ORDER]), F.col(label) if isinstance(label, str) else label)


def score_to_label(scores: DataFrame) -> DataFrame:
    """Ordered label of each probability."""
    return scores.withColumn("fb_ad_likelihood", probability_label("fb_ad_prob"))


def label_distribution(scores: DataFrame, label: str = "fb_ad_likelihood") -> DataFrame:
    """Count and share of every label of the fixed order, absent ones as 0.

    The order is five conditional counts in one aggregate, so no join is needed.
    """
    counted = scores.agg(
        F.count("*").alias("_all"), *[F.count_if(F.col(label) == x).alias(x) for x in fx.LABEL_ORDER]
    )
    return counted.unpivot("_all", fx.LABEL_ORDER, "label", "n").select(
        label_rank("label").cast("int").alias("position"), "label", "n", share(F.col("n"), F.col("_all")).alias("share")
    )


def merge_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Score and label on each row, stale score columns dropped; the final label wins where there is one."""
    final = "fb_ad_likelihood_final" if "fb_ad_likelihood_final" in scores.columns else "fb_ad_likelihood"
    dim = scores.select("company_name", "fb_ad_prob", F.col(final).alias("fb_ad_likelihood"))
    return enrich(rows.drop(*fx.SCORE_COLUMNS), dim, "company_name")


def outreach_sample(entrepreneurs: DataFrame, year: int = 2019, n: int = 5000, seed: int = 42) -> DataFrame:
    """Seeded sample of the companies whose entrepreneurs started in a year."""
    rows = entrepreneurs.where((F.col("job_from") == year) & F.col("company_name").isNotNull())
    cols = keep_columns(rows, ["company_name", "fb_ad_prob", "fb_ad_likelihood", "job_from"])
    return sample_n(keep_first(cols, "company_name"), n, "company_name", seed)


def validation_sample(scores: DataFrame, n_per_label: int = 40, seed: int = 42, shuffle_seed: int = 99) -> DataFrame:
    """Up to n companies of each label, in a seeded order."""
    labelled = scores.where(F.col("fb_ad_likelihood").isin(*fx.LABEL_ORDER))
    chosen = first_k(labelled, "fb_ad_likelihood", n_per_label, [seeded("company_name", seed)])
    return chosen.orderBy(seeded("company_name", shuffle_seed), "company_name")


def _both_labelled(sample: DataFrame, model: str, other: str) -> DataFrame:
    return sample.where(F.col(other).isNotNull()).withColumn(
        "agree", F.coalesce(F.col(model) == F.col(other), F.lit(False))
    )


def agreement(sample: DataFrame, model: str = "fb_ad_likelihood", other: str = "gpt_label") -> DataFrame:
    """Compared rows, agreements, disagreements and the agreement rate."""
    return _both_labelled(sample, model, other).agg(
        F.count("*").alias("n_total"),
        F.count_if("agree").alias("n_agree"),
        F.count_if(~F.col("agree")).alias("n_disagree"),
    ).withColumn("pct_agree", share(F.col("n_agree"), F.col("n_total")) * 100)


def disagreements(sample: DataFrame, model: str = "fb_ad_likelihood", other: str = "gpt_label") -> DataFrame:
    """Rows on which the labels differ."""
    return _both_labelled(sample, model, other).where(~F.col("agree")).drop("agree")


def disagreement_counts(sample: DataFrame, model: str = "fb_ad_likelihood", other: str = "gpt_label") -> DataFrame:
    """Disagreements by direction, most frequent first."""
    return (
        disagreements(sample, model, other)
        .groupBy(F.col(model).alias("model_said"), F.col(other).alias("other_said"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "model_said", "other_said")
    )


def overrides_table(scores: DataFrame, force_label: Mapping[str, str]) -> DataFrame:
    """Hand-made overrides as a table ``company_name, label``."""
    return scores.sparkSession.createDataFrame(list(force_label.items()), "company_name string, label string")


def apply_overrides(scores: DataFrame, overrides: DataFrame) -> DataFrame:
    """``fb_ad_likelihood_final``: the override where it is a known label, else the model's."""
    valid = keep_first(overrides.where(F.col("label").isin(*fx.LABEL_ORDER)), "company_name")
    out = enrich(scores, valid.withColumnRenamed("label", "_forced"), "company_name")
    return out.withColumn("fb_ad_likelihood_final", F.coalesce("_forced", "fb_ad_likelihood")).drop("_forced")


def override_problems(scores: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides that cannot apply, with the reason: bad label, or unknown company."""
    known = scores.select("company_name").distinct().withColumn("_known", F.lit(True))
    bad_label = ~F.coalesce(F.col("label").isin(*fx.LABEL_ORDER), F.lit(False))
    return overrides.join(known, "company_name", "left").select(
        "company_name",
        "label",
        F.when(bad_label, "invalid label").when(F.col("_known").isNull(), "unknown company").alias("problem"),
    ).where(F.col("problem").isNotNull())


def overrides_applied(final: DataFrame) -> DataFrame:
    """Number of labels an override changed."""
    return final.agg(F.count_if(F.col("fb_ad_likelihood_final") != F.col("fb_ad_likelihood")).alias("n_changed"))


def score_extremes(scores: DataFrame, n: int = 30) -> DataFrame:
    """Most confident ends and the least certain middle (C45, T2, T5); the limits are the report."""
    cols = ["company_name", "fb_ad_likelihood", "fb_ad_prob"]
    label, p = F.col("fb_ad_likelihood"), F.col("fb_ad_prob")
    rows = scores.select(*cols)
    views = [
        ("top", rows.where(label == fx.LABEL_ORDER[0]).orderBy(F.desc("fb_ad_prob"), "company_name")),
        ("bottom", rows.where(label == fx.LABEL_ORDER[-1]).orderBy("fb_ad_prob", "company_name")),
        ("nearest_half", rows.where(label == fx.DEFAULT_LABEL).orderBy(F.abs(p - F.lit(0.5)), "company_name")),
    ]
    parts = [ordered.limit(n).withColumn("view", F.lit(name)) for name, ordered in views]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
