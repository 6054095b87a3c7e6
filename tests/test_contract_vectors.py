import json

from pyspark.sql import functions as F

from rentlens.operators import features

MODELS = [("wide", ["a", "name", "flag", "absent", "대지권면적(㎡)"], ["name"]), ("narrow", ["name", "kind", "a"], ["name", "kind"])]
DEFAULTS = [("wide", "a", "9.5"), ("wide", "name", "N"), ("wide", "flag", "1"), ("wide", "대지권면적(㎡)", "0"), ("narrow", "a", "-1e3"), ("narrow", "name", "1e5"), ("narrow", "kind", 'K "q"')]
COLUMNS = "model_key string, features array<string>, categorical_features array<string>"


def vectors(spark, defaults=DEFAULTS):
    models = spark.createDataFrame(MODELS, COLUMNS)
    policy = features.feature_policy(models, spark.createDataFrame(defaults, "model_key string, feature string, value string"))
    df = spark.createDataFrame(
        [(1, "wide", float("nan"), 0, " ", True, "x"), (2, "wide", 2.5, 3, "x", False, "x"), (3, "narrow", float("inf"), 0, None, None, "x"), (4, "narrow", 1.0, 7, "y", True, "x"),
         (5, "unknown", 1.0, 7, "y", True, "x"), (6, None, None, None, None, None, None)], "id int, model_key string, a double, kind int, name string, flag boolean, extra string")
    return features.contract_vectors(df, policy, ["a", "kind", "name", "flag"])


def test_each_model_has_its_own_vector(spark):
    got = {r.id: r for r in vectors(spark).collect()}
    assert len(got) == 6
    value = lambda r: [v.text if v.categorical else v.number for v in r.vector]
    assert value(got[1]) == [9.5, "N", 1.0, None, 0.0] and got[1].fallback_features == ["a", "name", "flag", "absent"]
    assert (got[1].unavailable_features, got[1].missing_features, got[1].categorical_indices) == (["대지권면적(㎡)"], ["absent"], [1])
    assert value(got[2]) == [2.5, "x", 1.0, None, 0.0] and got[2].fallback_features == ["flag", "absent"]
    assert value(got[3]) == ["1e5", 'K "q"', -1000.0] and got[3].fallback_features == ["name", "kind", "a"]
    assert value(got[4]) == ["y", "7", 1.0] and (got[4].fallback_features, got[4].categorical_indices) == ([], [0, 1])
    assert got[5].vector is None and got[6].vector is None and got[5].fallback_features is None


def test_model_tables_have_different_widths(spark):
    v = vectors(spark)
    wide, narrow = (features.model_table(v, names, cats, key, ["id"]) for key, names, cats in MODELS)
    assert wide.dtypes == [("id", "int"), ("a", "double"), ("name", "string"), ("flag", "double"), ("absent", "double"), ("대지권면적(㎡)", "double")]
    assert narrow.dtypes == [("id", "int"), ("name", "string"), ("kind", "string"), ("a", "double")]
    assert [tuple(r) for r in narrow.orderBy("id").collect()] == [(3, "1e5", 'K "q"', -1000.0), (4, "y", "7", 1.0)]


def test_defaults_written_and_read(spark, tmp_path):
    path = str(tmp_path / "defaults.json")
    rows = spark.createDataFrame(DEFAULTS + [("wide", "gone", None)], "model_key string, feature string, value string")
    for _ in range(2):
        features.write_defaults(rows, path, "v7", "m1", ["name", "kind"])
    doc = json.loads(spark.read.text(path).first()[0])
    assert (doc["version"], doc["feature_manifest_version"]) == ("v7", "m1")
    assert doc["models"] == {"wide": {"a": 9.5, "name": "N", "flag": 1, "대지권면적(㎡)": 0}, "narrow": {"a": -1000.0, "name": "1e5", "kind": 'K "q"'}}
    back = features.read_defaults(spark, path).withColumn("number", F.col("value").try_cast("double"))
    assert {(r.model_key, r.feature, r.value if r.feature in ("name", "kind") else r.number) for r in back.collect()} == {
        (m, f, v if f in ("name", "kind") else float(v)) for m, f, v in DEFAULTS}
