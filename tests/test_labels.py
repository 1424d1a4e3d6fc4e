"""Replies, batches, resuming, scores and entity matching."""

import json

import pytest
from pyspark.sql import functions as F

from careerloom.functions.replies import known_label, reply_items
from careerloom.operators import embedding, entities, labelling, profiling, scoring
from careerloom.plans import catalogue
from conftest import rows

LABELS = ["visual", "non_visual", "unknown"]


@pytest.mark.parametrize("reply,want", [
    ('[{"company_name": "a", "label": "x"}]', [("a", "x")]),
    ('```json\n[{"company_name": "a", "label": "x"}]\n```', [("a", "x")]),
    ('```[{"company_name": "a", "label": "x"}]```', [("a", "x")]),
    ('{"n": 1, "results": [{"company_name": "a", "label": "x"}, {"company_name": "b"}]}', [("a", "x"), ("b", None)]),
    ('{"a": {"label": "x"}, "b": {"company_name": "c", "label": "y"}}', [("a", "x"), ("c", "y")]),
    ('{"company_name": "a", "label": "x"}', [("a", "x")]),
    ("[]", []), ("nonsense", []), ('[{"company_name": "a"', []), ("", []), (None, []), ("3", []),
])
def test_reply_shapes(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "r string").select(F.explode(reply_items("r")).alias("x"))
    assert [tuple(r) for r in df.select("x.company_name", "x.label").collect()] == want


def test_unknown_label_becomes_the_default(spark):
    df = spark.createDataFrame([(" Likely ",), ("odd",), (None,)], "l string").coalesce(1)
    assert [r[0] for r in df.select(known_label("l")).collect()] == ["likely", "unclear", "unclear"]


def names(spark, n, prefix="n"):
    return spark.range(n).select(F.concat(F.lit(prefix), F.col("id")).alias("company_name"))


def test_batches_hold_every_name_once(spark):
    got = labelling.name_batches(names(spark, 230).unionByName(names(spark, 50)), size=20, buckets=3)
    assert got.where("size(names) > 20").count() == 0
    assert got.select(F.explode("names")).count() == got.select(F.explode("names")).distinct().count() == 230
    short = got.where("size(names) < 20").groupBy("bucket").count()
    assert short.where("count > 1").count() == 0


def labeler(tag):
    def answer(request):
        import json

        return json.dumps({n: {"label": tag} for n in json.loads(request)})

    return answer


def test_resume(spark, tmp_path):
    log = str(tmp_path / "log")
    first = labelling.resume_labels(names(spark, 30), log, labeler("visual"), LABELS, "unknown")
    assert first.count() == 30
    both = labelling.resume_labels(names(spark, 50), log, labeler("odd"), LABELS, "unknown")
    assert rows(labelling.label_counts(both)) == [("unknown", 20), ("visual", 30)]
    again = labelling.resume_labels(names(spark, 50), log, labeler("visual"), LABELS, "unknown")
    assert rows(again) == rows(both) and labelling.label_log(spark, log).count() == 50


def test_the_query_makes_its_names_once(spark, sf, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    monkeypatch.setattr(catalogue, "_job_names", lambda *_: names(spark, 40).mapInPandas(counted, "company_name string"))
    assert catalogue.resume_labels(spark, sf).count() == 40
    assert made.value == 40


def test_latest_record_wins_and_broken_lines_are_skipped(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    lines = [json.dumps({"company_name": "a", "label": lab, "run": run}) for lab, run in (("old", 1), ("new", 2))]
    (path / "part.json").write_text("\n".join([lines[1], "{oops", lines[0], '{"label": "x"}']))
    got = labelling.latest_labels(labelling.label_log(spark, str(path)))
    assert rows(got.select("company_name", "label")) == [("a", "new")]


@pytest.fixture(scope="module")
def scores(spark):
    df = spark.range(100).select(F.concat(F.lit("c"), "id").alias("company_name"), (F.col("id") / 100).alias("fb_ad_prob"))
    return scoring.score_to_label(df)


def test_distribution_keeps_absent_labels(scores):
    got = rows(scoring.label_distribution(scores.where("fb_ad_prob < 0.5")).select("position", "n"))
    assert got == [(1, 0), (2, 0), (3, 15), (4, 15), (5, 20)]


def test_overrides(spark, scores):
    over = scoring.overrides_table(scores, {"c1": "likely", "c2": "sure", "zz": "likely"})
    final = scoring.apply_overrides(scores, over)
    assert scoring.overrides_applied(final).first()[0] == 1 and final.count() == 100
    assert rows(scoring.override_problems(scores, over).select("company_name", "problem")) == [("c2", "invalid label"), ("zz", "unknown company")]
    merged = scoring.merge_scores(spark.createDataFrame([("c1", 9.0), ("q", 1.0)], "company_name string, fb_ad_prob double"), final)
    assert rows(merged) == [("c1", 0.01, "likely"), ("q", None, None)]


def test_validation_sample(scores):
    got = scoring.validation_sample(scores, 7)
    assert got.groupBy("fb_ad_likelihood").count().where("count <> 7").count() == 0 and got.count() == 35


def test_agreement(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None), (None, "a")], "fb_ad_likelihood string, gpt_label string")
    r = scoring.agreement(df).first()
    assert (r.n_total, r.n_agree, r.n_disagree) == (3, 1, 2)


def test_match_types_partition_the_rows(spark):
    exp = spark.createDataFrame([(1, "ACME "), (2, "The Acme Co."), (3, "Inc."), (4, "Other"), (5, None)], "id int, company_name string")
    ent = spark.createDataFrame([("Acme",), ("Acme Inc",), ("The Co.",), (None,)], "entity_name string")
    typed = entities.match_types(entities.match_normalised_names(exp, ent), ent)
    got = {r.id: r.match_type for r in typed.collect()}
    exact, ruled, empty, other = entities.fx.MATCH_TYPES
    assert got == {1: exact, 2: ruled, 3: empty, 4: other, 5: empty}
    report = entities.ambiguous_key_report(ent, typed).first()
    assert (report.entity_name_norm, report.n_names, report.experience_rows) == ("acme", 2, 2)
    assert report.name_examples == ["Acme", "Acme Inc"]
    with pytest.raises(Exception, match="not unique"):
        twice = spark.createDataFrame([("acme", "x"), ("acme", "y")], "company_name_norm string, entity_name_matched string")
        entities.match_normalised_names(exp, ent, twice).collect()


def test_embeddings(spark):
    vocab = spark.createDataFrame([("big", [1.0, 2.0]), ("co", [3.0, 0.0])], "word string, vec array<float>")
    df = spark.createDataFrame([("big co",), ("big big x",), ("x",), ("Big",), ("",), (None,)], "company_name string")
    got = {r.company_name: list(r.embedding) for r in embedding.embed_names(df, vocab, "company_name", 2).collect()}
    assert got == {"big co": [2.0, 1.0], "big big x": [1.0, 2.0], "x": [0.0, 0.0], "Big": [0.0, 0.0], "": [0.0, 0.0]}
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(embedding.l2_normalised("v"))
    assert rows(unit) == [([0.0, 0.0],), ([0.6, 0.8],)]


def test_regression_solves_the_penalised_problem(spark):
    """Gradient of C * sum(loss) + |w|^2 / 2 is zero at the fitted weights, with and without scaling."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) * [1.0, 5.0, 0.2]
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(int)
    emb = spark.createDataFrame([(f"n{i}", [float(v) for v in row]) for i, row in enumerate(x)], "company_name string, embedding array<double>")
    labels = spark.createDataFrame([(f"n{i}", int(v)) for i, v in enumerate(y)] + [("n0x", None)], "company_name string, y int")
    train = embedding.train_xy(labels, emb, "y")
    assert train.count() == 200
    for scaled in (False, True):
        fitted = embedding.fit_classifier(train, standardise=scaled)
        z = (x - x.mean(0)) / x.std(0) if scaled else x
        w, b = fitted.weights[:-1], fitted.weights[-1]
        p = 1 / (1 + np.exp(-(z @ w + b)))
        assert np.abs(z.T @ (p - y) + w).max() < 1e-6 and abs((p - y).sum()) < 1e-6
        got = {r.company_name: r.p for r in fitted.score(emb, "p").collect()}
        assert max(abs(got[f"n{i}"] - p[i]) for i in range(200)) < 1e-6


def test_models_fitted_together_equal_models_fitted_alone(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = [(f"n{i}", [float(v) for v in rng.normal(size=4)], float(rng.random() < 0.4)) for i in range(300)]
    data += [("same", [1e3, 0.0, 0.0, 0.0], 1.0)]
    train = spark.createDataFrame(data, "company_name string, v array<double>, y double").repartition(9)
    train = train.select("company_name", "y", F.expr("v").alias("v")).withColumn("features", embedding.array_to_vector("v"))
    both = embedding.fit_all(train, {"odd": ("length(company_name) % 2 = 1", True), "all": ("true", False), "none": ("false", False), "ones": ("y = 1", True)})
    odd = embedding.fit_classifier(train.where("length(company_name) % 2 = 1"), standardise=True)
    assert np.allclose(both["odd"].weights, odd.weights, atol=1e-7) and np.allclose(both["odd"].shift, odd.shift)
    assert np.allclose(both["all"].weights, embedding.fit_classifier(train.coalesce(1)).weights, atol=1e-7)
    assert {r.p for r in both["ones"].score_features(train, "p").collect()} == {1.0}
    folds = embedding.cross_validated_auc(train).first()
    assert 0.3 < folds.auc_mean < 0.8 and folds.auc_sd < 0.3


def test_crosstab_margins(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False)], "a boolean, b boolean")
    got = {(r.a, r.b): r.n for r in profiling.crosstab(df, "a", "b").collect()}
    assert got[("All", "All")] == 3 and got[("true", "All")] == 2 and got[("All", "false")] == 2
