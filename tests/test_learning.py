"""Models of words and pairs: scored by joins as the pipeline scores them, learnt for all surfaces in one plan."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocabrook.operators import disambiguation, learning
from vocabrook.operators.grounding import Grounder, context_key
from vocabrook.sources import lexicon

N = None
WORDS = {"a": "estrogen hormone binding cell the of", "b": "membrane organelle lumen cell the of", "c": "bone joint pain cell the of"}


def text(rnd, label):
    return " ".join(rnd.choice([*WORDS[label].split(), f"x{rnd.randint(0, 20)}"]) for _ in range(rnd.randint(3, 14)))


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(1)
    rows = [("ER", x, text(rnd, x)) for x in "ab" for _ in range(20)] + [("TT", x, text(rnd, x)) for x in "abc" for _ in range(15)]
    return spark.createDataFrame([*rows, *[("few", "a", "one label")] * 9, *[("rare", x, f"{x} {k}") for x in "ab" for k in range(3)], ("ER", "a", N), (N, "a", "lost")], "surface string, label string, text string").cache()


@pytest.fixture(scope="module")
def models(texts):
    return learning.learn(texts, sizes=(5000,), folds=4).cache()


def probabilities(spark, surface, contexts, models):
    asked = spark.createDataFrame([(surface, c) for c in contexts], "raw string, context string").withColumn("context_key", context_key("context"))
    found = disambiguation.label_probabilities(asked, asked.select("context_key", "context"), models)
    return {(r.context, r.label): r.probability for r in found.filter(F.col("raw") == surface).join(asked, "context_key").collect()}


@pytest.mark.parametrize("surface", ["ER", "TT"])
def test_joins_and_batches_give_the_pipelines_probabilities(spark, texts, models, surface):
    rnd = random.Random(2)
    model, _ = disambiguation.train(texts.filter(F.col("surface") == surface).filter("text is not null").select("text", "label"), sizes=(5000,), folds=2)
    contexts = [text(rnd, x) for x in "abc" for _ in range(5)] + ["Nothing known HERE"]
    told = model.transform(spark.createDataFrame([(c, "a") for c in contexts], "text string, label string")).collect()
    want = {(r.text, x): float(p) for r in told for x, p in zip(model.stages[0].labels, r.probability, strict=True)}
    joined = probabilities(spark, surface, contexts, disambiguation.model_rows(spark, model, surface))
    batch = probabilities(spark, surface, contexts, models)
    assert set(joined) == set(batch) == set(want)
    assert max(abs(joined[k] - want[k]) for k in want) < 1e-12
    assert max(abs(batch[k] - want[k]) for k in want) < 1e-4


def test_learnt_surfaces(models):
    assert {r.surface for r in models.select("surface").distinct().collect()} == {"ER", "TT"}
    assert all(r.f1 > 0.9 for r in models.select("f1").distinct().collect())
    rows = models.filter("surface = 'ER'").collect()
    # each label has every feature, as the length of a context needs them, and one intercept
    assert len({r.feature for r in rows if r.label == "a"}) == len({r.feature for r in rows if r.label == "b"}) == len(rows) / 2
    assert sum(r.feature is None for r in rows) == 2 and all((r.feature is None) == (r.idf is None) for r in rows)


def test_folds_and_sizes(spark, texts):
    """The best size by held-out F1; texts that repeat, one label's many texts, a cutoff that nobody meets."""
    assert learning.learn(texts, folds=4, cutoff=1.0).count() == 0
    small = learning.learn(texts.unionByName(texts), sizes=(3, 60), folds=3, most=12)
    assert {r["size"] for r in small.select("size").distinct().collect()} <= {3, 60}
    assert learning.learn(texts.limit(0)).count() == 0


def test_one_plan_for_all_surfaces(texts):
    plan = learning.learn(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "LocalRelation" not in plan


def test_f1_and_descent():
    assert learning.weighted_f1(np.array(["a", "a", "b"]), np.array(["a", "b", "b"])) == pytest.approx((2 / 3) * (2 / 3) + (1 / 3) * (2 / 3))
    a = np.diag([1.0, 10.0, 100.0])
    x = learning.descend(lambda p: (0.5 * p @ a @ p - p.sum(), a @ p - 1), np.zeros(3))
    assert np.allclose(x, [1, 0.1, 0.01], atol=1e-6)


def test_a_model_in_grounding(spark, models):
    rows = [("er", "ER", "db", k, k, "synonym", "s", N, N, N) for k in ("a", "b")]
    own = models.withColumn("label", F.concat(F.lit("db:"), "label"))
    g = Grounder(spark, spark.createDataFrame(rows, lexicon.TERMS), models=own)
    best = {c: g.ground_text("ER", context=c).first()["id"] for c in ("estrogen hormone binding", "membrane organelle lumen")}
    assert best == {"estrogen hormone binding": "a", "membrane organelle lumen": "b"}


def test_model_file(spark, tmp_path):
    """A file of models: two labels have one vector, three have three."""
    model = lambda classes, intercepts, vectors, f1: {"logit": {"classes_": classes, "intercept_": intercepts, "coef_": vectors}, "tfidf": {"vocabulary_": {"x": 0, "x y": 1}, "idf_": [1.0, 2.0]}, "stats": {"f1": {"mean": f1}}}
    (tmp_path / "m.json").write_text(json.dumps({"AB": model(["p", "q"], [0.5], [[1.0, -1.0]], 0.9), "ABC": model(["p", "q", "r"], [0.1, 0.2, 0.3], [[1, 2], [3, 4], [5, 6]], 0.8), "bad": model(["p", "q"], [0.0], [[0, 0]], 0.5)}))
    rows = lexicon.read_model_rows(spark, str(tmp_path / "m.json"))
    got = {(r.surface, r.label, r.feature): (r.weight, r.idf) for r in rows.collect()}
    assert len(got) == 6 + 9 and got["AB", "p", "x y"] == (0.0, 2.0) and got["AB", "q", "x y"] == (-1.0, 2.0) and got["AB", "q", N] == (0.5, N) and got["ABC", "r", "x"] == (5.0, 1.0)
    p = probabilities(spark, "AB", ["x y z"], rows)
    z = 0.5 + (1.0 * 1 - 1.0 * 2) / math.sqrt(5)
    assert p["x y z", "q"] == pytest.approx(1 / (1 + math.exp(-z)))
