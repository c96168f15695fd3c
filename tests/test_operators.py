import pytest
from pyspark.sql import functions as F

from lariat.operators import drift, features, model, ranking, sampling, stats
from lariat.plans.training import run_drift
from lariat.sources.tables import load_model, save_model
from lariat.streaming.scoring import score_stream


def test_counts_and_rates(spark):
    df = spark.createDataFrame([("b", 1), ("a", 0), ("a", 1), (None, 1), ("b", 1)], "k string, target int")
    assert [tuple(r) for r in stats.value_counts(df, "k").collect()] == [("a", 2), ("b", 2)]
    assert [tuple(r) for r in stats.value_share(df, "k").collect()] == [("a", 0.5), ("b", 0.5)]
    assert [tuple(r) for r in stats.rate_by(df, "k").collect()] == [("b", 1.0), ("a", 0.5)]
    assert [tuple(r) for r in stats.count_and_rate_by(df, "k", top=1).collect()] == [("a", 2, 0.5)]
    assert stats.class_ratio(df).first().ratio == 4.0
    with pytest.raises(Exception):
        stats.class_ratio(df.where("target = 1")).collect()


def test_confusion(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "target int, prediction int")
    assert [tuple(r) for r in stats.confusion_matrix(df).collect()] == [(0, 1, 1), (1, 0, 2)]
    assert [tuple(r) for r in stats.confusion_percent(df).collect()] == [(0, 50.0, 50.0), (1, 0.0, 100.0)]
    rep = {r.label: r for r in stats.classification_report(df).collect()}
    assert rep["1"].precision == pytest.approx(2 / 3) and rep["0"].recall == 0.5 and rep["accuracy"].f1 == 0.75 and rep["macro avg"].support == 4
    assert all(r.f1 == 0 for r in stats.classification_report(df.where("false")).collect())


def test_top_k(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, float("nan")), (4, 0.9), (5, 0.1), (6, None)], "id int, s double")
    assert [r.id for r in ranking.top_k(df, "s", "id", 3).collect()] == [2, 4, 1]
    with pytest.raises(ValueError):
        ranking.top_k(df, "s", "id", -1)


@pytest.mark.parametrize("n, want", [(4, 0), (5, 0), (15, 2), (25, 2), (26, 3), (35, 4), (100, 10), (105, 10)])
def test_exact_sample(spark, n, want):
    assert sampling.exact_sample(spark.range(n), "id").count() == want


def test_split(spark):
    df = spark.range(1003).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    out = sampling.stratified_split(df, "id", "y")
    assert out.count() == 1003
    assert {r.y: r.n for r in out.where("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()} == {0: 150, 1: 50}
    rows = sorted(((r.h, r.id) for r in df.where("y = 1").select("id", sampling.hash_order("id").alias("h")).collect()))[:50]
    assert {r.id for r in out.where("is_test and y = 1").collect()} == {i for _, i in rows}


def test_features(spark):
    df = spark.createDataFrame([(f" v{i % 25}",) for i in range(60)] + [(None,)], "c string")
    got = features.bucket_rare(df, "c", 20)
    assert got.select("c").distinct().count() == 21 and got.count() == 61
    assert features.normalize_categories(df).where("c = 'Desconhecido'").count() == 1
    assert features.categorical_features(spark.range(1).withColumn("s", F.lit("x"))) == ["s"]
    with pytest.raises(ValueError):
        features.drop_column(df, "nope")
    assert features.drop_column(df, "nope", must_exist=False).columns == ["c"]
    levels = spark.createDataFrame([(" pos graduacao",), ("Doutorado cursando",), ("outro",), (None,)], "nivel_academico string")
    assert [r[0] for r in features.prepare_features(levels, rare_top_n=None).collect()] == ["Pós-Graduação", "Doutorado (Cursando)", "Outro", "Desconhecido"]
    assert features.prepare_features(levels, normalize=False, rare_top_n=None).collect() == levels.collect()
    two = df.select(F.col("c").alias("cliente"), F.col("c").alias("area_atuacao"))
    assert features.prepare_features(two, rare_top_n=3).select("cliente").distinct().count() == 4


def test_drift(spark, tmp_path):
    a = spark.createDataFrame([("x", 1.0)] * 5 + [("y", 3.0)] * 5, "c string, v double")
    b = spark.createDataFrame([("z", 9.0)] * 4, "c string, v double")
    rep = {r.column: r for r in drift.drift_report(a, b).collect()}
    assert rep["c"].statistic == pytest.approx(1.0) and rep["v"].statistic == pytest.approx(7.0) and rep["c"].drifted
    assert {r.statistic for r in drift.drift_report(a, a).collect()} == {0.0}
    assert drift.dataset_drift(drift.drift_report(a, b)).first().drifted
    assert drift.drift_html(drift.drift_report(a, b)).startswith("<table>")
    drift.write_drift_html(drift.drift_report(a, b), str(tmp_path / "page"))
    assert spark.read.text(str(tmp_path / "page"), wholetext=True).first()[0].startswith("<table>")
    keyed = spark.range(100).withColumn("c", F.lit("k"))
    assert not run_drift(keyed, "id").first().drifted


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(i, "abc"[i % 3], None if i % 5 == 0 else "s", int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a string, b string, target int")
    return df, model.fit(df, ["a", "b"], model.classifier("gbt", maxIter=3, maxDepth=3))


def test_model(spark, fitted, tmp_path):
    df, m = fitted
    top = model.predict_proba(m, df, "id", 5).collect()
    assert [r.id for r in top] == [0, 3, 6, 9, 12] or len(top) == 5
    assert all(0 <= r.prob_contratacao <= 1 for r in top) and top[0].prob_contratacao >= top[-1].prob_contratacao
    save_model(m, str(tmp_path / "m"))
    again = model.predict_proba(load_model(str(tmp_path / "m")), df, "id", 5).collect()
    assert again == top
    assert "target" not in model.rank_candidates(m, df, "id").columns
    assert {r.feature for r in model.feature_importance(m, df).collect()} <= {"a_a", "a_b", "a_c", "b_s", "b___null__"}
    assert 0 <= model.score_one(spark, m, {"a": "zzz", "b": "s"}, ["a", "b"]) <= 1
    with pytest.raises(ValueError):
        model.score_one(spark, m, {"a": 3}, ["a", "b"])


def test_training(spark, fitted):
    df, _ = fitted
    for weight in (None, "balanced", "positive"):
        clf = model.classifier("rf", weight="weight" if weight else None, numTrees=3, maxDepth=3)
        _, rep = model.train_and_evaluate(df, "id", ["a", "b"], clf, weight=weight)
        assert rep.count() == 5


def test_stream(spark, fitted, tmp_path):
    df, m = fitted
    df.drop("target").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.drop("target").schema).parquet(str(tmp_path / "in"))
    q = score_stream(m, stream).writeStream.format("memory").queryName("scored").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert spark.table("scored").count() == 60
