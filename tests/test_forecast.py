"""Forecasts: fit, calibration, saved artefacts, ablation and permutation importance."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.operators import forecast
from lodestar.plans.scores import FEATURES


@pytest.fixture(scope="module")
def blocks(spark, data):
    e = spark.read.parquet(f"{data}/events.parquet").where("user_id < 30")
    return forecast.block_features(e, "user_id", "ts", F.col("event_type") == "error", "2024-01-01", 60).where("y IS NOT NULL").persist()


@pytest.fixture(scope="module")
def model(blocks):
    return forecast.Danger.fit(blocks.where("block < 40"), blocks.where("block BETWEEN 40 AND 49"), FEATURES, rounds=2, depth=2)


def test_probabilities_and_card(spark, blocks, model, tmp_path):
    p = [r["p"] for r in model.predict(blocks.where("block >= 50")).collect()]
    assert p and all(0 <= x <= 1 for x in p)
    model.save(str(tmp_path / "m"), {"name": "danger"})
    assert json.loads(spark.read.text(str(tmp_path / "m" / "latest")).first()[0]) == {"name": "danger", "features": FEATURES}


def test_ablation_ranks_what_moves_the_forecast(blocks, model):
    got = forecast.ablation(model, blocks.where("block >= 55"), ["user_id", "block"], {"n28": 0.0, "since": 120.0}, top=1, least=0.0).collect()
    assert got and all(r["rank"] == 1 and r["altered"] in ("n28", "since") for r in got)


def test_a_feature_the_trees_ignore_has_no_importance(blocks, model):
    small = forecast.Danger(model.trees, model.calibration, ["weekday"])
    got = forecast.permutation_importance(small, blocks.where("block >= 50").limit(200).persist(), "y").collect()
    assert len(got) == 1 and abs(got[0]["rise"]) < 0.2


def test_time_split_leaves_nothing_out(blocks):
    a, b = forecast.time_split(blocks, "block", F.lit(30))
    assert a.count() + b.count() == blocks.count() and a.where("block >= 30").isEmpty()
