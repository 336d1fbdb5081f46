"""Set containment with marks against a plain loop."""

import random

from vocabrook.operators import set_join


def test_marks_drop_candidates_and_lose_none(spark):
    """Common elements, sets that fill all marks, sets of one, unknown and null elements."""
    rnd = random.Random(4)
    hays = {f"h{k}": {rnd.randrange(40) for _ in range(rnd.randint(1, 25))} for k in range(60)} | {"all": set(range(400)), "none": {999}}
    needles = {k: {rnd.randrange(40) for _ in range(rnd.randint(1, 5))} for k in range(200)} | {1000: set(range(0, 400, 2)), 1001: {777}, 1002: {999}, 1003: {1, None}, 1004: set(range(401))}
    rows = lambda sets: [(k, x) for k, s in sets.items() for x in s for _ in range(2)]
    got = set_join.contained_sets(spark.createDataFrame(rows(needles), "needle int, item int"), spark.createDataFrame(rows(hays), "hay string, item int"))
    want = sorted((n, h) for n, s in needles.items() for h, t in hays.items() if s <= t)
    assert sorted(map(tuple, got.collect())) == want and (1000, "all") in want
    # no element of a candidate without all marks is looked at: what is left before the count is nearly the result
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and "&" in plan
