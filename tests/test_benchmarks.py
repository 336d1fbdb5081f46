"""Orders of organisms a row, set containment, curated comparisons, spans with equivalents, descent in trees."""

import random

import pytest
from pyspark.sql import functions as F

from vocabrook.operators import evaluation, lexicon_ops, set_join
from vocabrook.operators.grounding import Grounder, best_organisms
from vocabrook.sources import lexicon

N = None


@pytest.fixture(scope="module")
def grounder(spark):
    rows = [("braf", "BRAF", "HGNC", "1097", "BRAF", "name", "hgnc", "9606", N, N), ("braf", "Braf", "UP", "P28028", "Braf", "name", "uniprot", "10090", N, N), ("braf", "braf", "UP", "Q1", "braf", "synonym", "uniprot", "7955", N, N),
            ("braf", "BRAF", "MESH", "D1", "BRAF", "synonym", "mesh", N, N, N)]
    return Grounder(spark, spark.createDataFrame(rows, lexicon.TERMS))


def test_each_row_has_its_own_order(spark, grounder):
    orders = {1: ["9606"], 2: ["10090", "9606"], 3: ["7955"], 4: ["4932"], 5: [], 6: N, 7: ["4932", "7955", "9606"]}
    df = spark.createDataFrame([(k, " BRAF ", o) for k, o in orders.items()] + [(8, "zzz", ["9606"])], "k int, t string, o array<string>")
    got = {}
    for r in grounder.ground(df, "t", organisms="o").collect():
        got.setdefault(tuple(r.organisms), []).append((r.rank, r.id))
    # each order gives what a grounding with that one list gives
    for o in {tuple(o or ["9606"]) for o in orders.values()}:
        alone = grounder.ground(df.select("t").distinct(), "t", organisms=list(o)).collect()
        assert sorted(got[o]) == sorted((r["rank"], r.id) for r in alone)
    assert {i for _, i in got["4932",]} == {"D1"} and {i for _, i in got["4932", "7955", "9606"]} == {"Q1", "D1"}


def test_columns_and_entities_with_orders(spark, grounder):
    df = spark.createDataFrame([(1, "BRAF", ["10090"]), (2, "BRAF", ["9606"]), (3, "none", N), (4, N, ["9606"])], "k int, curie string, organisms array<string>")
    assert {r.k: r.best for r in grounder.ground_column(df, "curie", "best", organisms="organisms").collect()} == {1: "uniprot:P28028", 2: "hgnc:1097", 3: N, 4: N}
    both = {r.k: r for r in grounder.ground_entities(df, "curie", "organisms").collect()}
    assert both[1].groundings[0].curie == "uniprot:P28028" and both[1].groundings_no_context[0].curie == "hgnc:1097"
    assert both[3].groundings == both[4].groundings == [] and both[2].groundings == both[2].groundings_no_context


def test_best_organism_is_a_minimum_not_a_window(spark, grounder):
    df = spark.createDataFrame([("BRAF", ["9606"])], "raw string, organisms array<string>")
    plan = best_organisms(grounder.entries(df), df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_a_string_meets_a_text_once(spark, grounder):
    """However many entries a text has, it is scored once; the entries come afterwards."""
    many = spark.createDataFrame([("braf", "BRAF", "X", str(k), "BRAF", "name", "x", N, N, N) for k in range(500)], lexicon.TERMS)
    g = Grounder(spark, many)
    asked = spark.createDataFrame([("BRAF",), ("braf",)], "raw string")
    assert g.pairs(asked).count() == 2 and g.entries(asked).count() == 1000
    plan = g.entries(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [norm_text" in plan and plan.count("Join Inner") == 2


# ---- sets


@pytest.mark.parametrize("seed", range(3))
def test_contained_sets(spark, seed):
    rnd = random.Random(seed)
    needles = {k: {rnd.randrange(12) for _ in range(rnd.randint(1, 4))} for k in range(40)}
    hays = {k: {rnd.randrange(10) for _ in range(rnd.randint(1, 9))} for k in range(40)}
    rows = lambda sets, name: spark.createDataFrame([(k, x) for k, xs in sets.items() for x in [*xs, *list(xs)[:1]]], f"{name} int, item int")
    found = set_join.contained_sets(rows(needles, "needle"), rows(hays, "hay"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((a, b) for a, x in needles.items() for b, y in hays.items() if x <= y)


def test_contained_sets_plan_and_empty(spark):
    a, b = spark.createDataFrame([(1, "x")], "needle int, item string"), spark.createDataFrame([(2, "x")], "hay int, item string")
    plan = set_join.contained_sets(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert set_join.contained_sets(a.limit(0), b).count() == set_join.contained_sets(a, b.limit(0)).count() == 0


def test_synonym_sets_take_families_whose_members_are_all_there(spark):
    golds = spark.createDataFrame([(["UP:1", "UP:2"],), (["UP:1"],), (["UP:1"],), ([],)], "curies array<string>")
    links = spark.createDataFrame([("UP:1", "HGNC:1"), ("UP:2", "HGNC:2")], "curie string, other string")
    families = spark.createDataFrame([("AB", "HGNC:1"), ("AB", "HGNC:2"), ("A", "HGNC:1")], "family string, member string")
    got = {tuple(r.curies): r.synonyms for r in set_join.synonym_sets(golds, [links], families).collect()}
    assert got == {("UP:1", "UP:2"): ["FPLX:A", "FPLX:AB", "HGNC:1", "HGNC:2", "UP:1", "UP:2"], ("UP:1",): ["FPLX:A", "HGNC:1", "UP:1"], (): []}


def test_descent(spark):
    nodes = spark.createDataFrame([("p", "D12.776.157.2"), ("p", "D08.811"), ("e", "D08.811.277"), ("x", "D12.7760.1"), ("d", "C04.557"), ("n", N)], "id string, tree_number string")
    assert {tuple(r) for r in lexicon_ops.mesh_classes(nodes).collect()} == {("p", "protein"), ("p", "chemical"), ("e", "protein"), ("e", "chemical"), ("x", "chemical")}


# ---- comparisons


def test_curated_file_to_bounds(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        "Text,EntityType,Sentence,Grounding,DB_Ns1,DB_Id1,DB_Ns2,DB_Id2,DB_Ns3,DB_Id3\n"
        'a,protein,"one, two",1,HGNC,1,,,,\nb,process,s,0,GO,GO:GO:5,,,,\nc,chemical,s,1,PUBCHEM,77,CHEBI,CHEBI:0,,\nd,x,s,0,,,,,,\ne,x,s,1,UP,1,,,,\nf,x,s,,,,,,,\ng,x,s,1,UP,9,,,,\n'
    )
    rows = lexicon.read_curated(spark, str(tmp_path / "c.csv"), spark.createDataFrame([("77", "CHEBI:5")], "id string, chebi_id string")).cache()
    assert {r.text: r.db_refs for r in rows.collect()} == {"a": {"HGNC": "1"}, "b": {"GO": "GO:5"}, "c": {"PUBCHEM": "77", "CHEBI": "CHEBI:5"}, "d": {}, "e": {"UP": "1"}}
    told = spark.createDataFrame([("a", "HGNC", "1"), ("b", "GO", "GO:5"), ("c", "CHEBI", "CHEBI:9"), ("d", N, N), ("e", "UP", "2")], "text string, db string, id string")
    sure = spark.createDataFrame([("e", "UP", "2", False), ("e", "UP", "2", True)], "text string, db string, id string, right boolean")
    out = evaluation.new_status(rows.join(told, "text"), sure).withColumn("old", evaluation.old_status())
    assert {r.text: (r.old, r.new) for r in out.collect()} == {"a": ("correct", "correct"), "b": ("incorrect", "incorrect"), "c": ("correct", "unknown"), "d": ("ungrounded", "ungrounded"), "e": ("correct", "correct")}
    matrix = evaluation.comparison_matrix(out)
    assert matrix.count() == 12 and matrix.agg(F.sum("n")).first()[0] == 5
    got = {r.trial: (round(r.precision, 6), round(r.recall, 6)) for r in evaluation.comparison_bounds(matrix).collect()}
    assert got == {"reference": (0.75, 0.75), "least": (0.5, round(2 / 3, 6)), "largest": (0.75, 0.75)}
    assert [r.f1 for r in evaluation.comparison_bounds(evaluation.comparison_matrix(out.limit(0))).collect()] == [0.0] * 3


def test_spans_against_plain_loops(spark):
    rnd = random.Random(8)
    key = lambda: ("d", rnd.randrange(2), rnd.choice("xy"), rnd.randrange(3), 9)
    gold = [(*key(), rnd.sample("abcdef", 2)) for _ in range(25)]
    found = [(*key(), rnd.sample("abcdefgh", rnd.randint(0, 3))) for _ in range(40)]
    all_tp = top_tp = fp = fn = 0
    for *k, matches in found:
        hits = [i for i, m in enumerate(matches) if any(g[:5] == tuple(k) and m in g[5] for g in gold)]
        all_tp, top_tp, fp = all_tp + bool(hits), top_tp + (0 in hits), fp + (not hits)
    for g in gold:
        fn += not any(f[:5] == g[:5] and set(f[5]) & set(g[5]) for f in found)
    schema = "doc string, figure int, text string, start int, end int, {} array<string>"
    out = evaluation.ner_evaluation(spark.createDataFrame(gold, schema.format("curies")), spark.createDataFrame(found, schema.format("matches")))
    assert {r.match_type: (r.tp, r.fp, r.fn) for r in out.collect()} == {"all": (all_tp, fp, fn), "top": (top_tp, fp, fn)}


def test_span_and_class_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text("text,obj,don_article,figure,first left,last right\nBRAF,Uniprot:P1|NCBI gene:5,12,F1-A,3,7\nblob,other:1,12,F1-A,9,13\n")
    (r,) = lexicon.read_bioid_spans(spark, str(tmp_path / "g.csv")).collect()
    assert (r.doc, r.figure, r.start, r.end, r.obj, r.entity_type) == ("12", "F1-A", 3, 7, ["UP:P1", "NCBI gene:5"], "Gene")
    (tmp_path / "o.owl").write_text("Prefix MESH:D9\n# Class: obo:CL_0000001 (a)\nxref MESH:D1\nxref MESH:D1 MESH:D1\n# Class: obo:CL_0000002 (b)\nMESH:D2 MESH:D3\n# Class: obo:CL_0000003 (c)\nMESH:D4\nMESH:C5\n")
    assert {tuple(r) for r in lexicon.read_class_blocks(spark, str(tmp_path / "o.owl")).collect()} == {("CL:0000001", "MESH:D1"), ("CL:0000003", "MESH:C5")}


# ---- trials and reports


def test_trials_and_batches(spark):
    rows = spark.range(57).withColumn("t", F.concat(F.lit("w"), "id"))
    out = evaluation.trials(rows, 10, 3).groupBy("trial").agg(F.countDistinct("id").alias("n")).collect()
    assert sorted(tuple(r) for r in out) == [(1, 10), (2, 10), (3, 10)]
    batches = evaluation.batched(rows, "t", 10).collect()
    assert all(1 <= len(b["items"]) <= 10 for b in batches) and sorted(x for b in batches for x in b["items"]) == sorted(f"w{k}" for k in range(57))
    assert evaluation.batched(rows.limit(0), "t").count() == 0


def test_report_lines(spark):
    table = spark.createDataFrame([("b", 2.5), ("a", N)], "name string, f1 double")
    assert [r.line for r in evaluation.table_lines(table, "name").collect()] == ["name & f1 \\\\", "a &  \\\\", "b & 2.5 \\\\"]
    assert [r.line for r in evaluation.table_lines(table, "name", kind="markdown").collect()] == ["| name | f1 |", "|---|---|", "| a |  |", "| b | 2.5 |"]
