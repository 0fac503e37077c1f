import pytest
from ledgermesh.operators import model
from pyspark.sql import functions as F


def test_out_of_fold_scores_and_saved_models(spark, tmp_path):
    rows = spark.range(600).select(F.concat(F.lit("S1-"), F.col("id") % 60).alias("s1_id"), F.concat(F.lit("S2-"), "id").alias("cand_id"), F.when(F.col("id") % 7 != 0, (F.col("id") % 10) / 10.0).alias("a"), F.rand(3).alias("b"))
    data = rows.withColumn("y", F.coalesce("a", F.lit(0.0)) >= 0.7)
    scored, models = model.out_of_fold(data, ["a", "b"], folds=2, trees=3, depth=3)
    joined = scored.join(data.select("s1_id", "cand_id", "y"), ["s1_id", "cand_id"])
    assert joined.count() == 600 and model.area_under_curve(joined) > 0.95
    assert {r.weight for r in model.training_rows(data).select("y", "weight").distinct().collect()} == {1.0, 5.0}
    model.save(models, f"{tmp_path}/m")
    loaded, names = model.load(f"{tmp_path}/m", 2)
    assert names == ["a", "b"]
    mean = lambda ms: sorted(map(tuple, model.mean_of(ms, data, names).select("cand_id", F.round("p", 9)).collect()))
    assert mean(models) == mean(loaded)
    with pytest.raises(ValueError):
        model.mean_of(models, data, ["b", "a"])


def test_folds_are_read_apart_and_train_on_the_others(spark, monkeypatch):
    from ledgermesh.sources.staging import materialize

    data = spark.range(200).select(F.concat(F.lit("S1-"), F.col("id") % 40).alias("s1_id"), F.concat(F.lit("S2-"), "id").alias("cand_id"), ((F.col("id") % 10) / 10.0).alias("a"), (F.col("id") % 10 >= 7).alias("y"))
    trained, scored_rows, fit, apply = [], [], model.fit, model.apply
    monkeypatch.setattr(model, "fit", lambda rows, *a, **k: trained.append(rows) or fit(rows, *a, **k))
    monkeypatch.setattr(model, "apply", lambda m, rows, *a: scored_rows.append(rows) or apply(m, rows, *a))
    written = materialize(model.with_fold(data, 2), "learned", by="fold")
    scored, _ = model.out_of_fold(written, ["a"], folds=2, negative_share=1.0, trees=1, depth=1)
    assert scored.count() == scored.distinct().count() == 200
    for k, (t, s) in enumerate(zip(trained, scored_rows, strict=True)):
        seen, own = ({r.s1_id for r in x.select("s1_id").collect()} for x in (t, s))
        assert seen and own and not seen & own and len(seen | own) == 40
        assert "features" in t.columns
        assert "PartitionFilters: [isnotnull(fold" in s._jdf.queryExecution().executedPlan().toString(), k


def test_folds_read_training_rows_written_once(spark, monkeypatch):
    data = spark.range(200).select(F.concat(F.lit("S1-"), F.col("id") % 40).alias("s1_id"), F.concat(F.lit("S2-"), "id").alias("cand_id"), ((F.col("id") % 10) / 10.0).alias("a"), (F.col("id") % 10 >= 7).alias("y"))
    read = []
    fit = model.fit
    monkeypatch.setattr(model, "fit", lambda rows, *a, **k: read.append(rows.inputFiles()) or fit(rows, *a, **k))
    scored, _ = model.out_of_fold(data, ["a"], folds=2, trees=1, depth=1)
    assert scored.count() == 200 and len(read) == 2 and all("/tables/training-" in f for files in read for f in files) and read[0]
