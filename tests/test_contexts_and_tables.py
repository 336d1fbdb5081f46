"""Contexts of annotations, plans that keep texts out of broadcasts, training texts, equivalents and tables."""

import re

from pyspark.sql import functions as F

from vocabrook.operators import annotation, disambiguation, etl, evaluation, lexicon_ops
from vocabrook.operators.grounding import Grounder
from vocabrook.sources import lexicon

N = None


def grounder(spark, models=None):
    rows = [("er", "ER", "HGNC", "1", "ESR1", "synonym", "hgnc", "9606", N, N), ("er", "ER", "GO", "GO:2", "endoplasmic reticulum", "synonym", "go", N, N, N), ("kinase", "kinase", "GO", "GO:3", "kinase", "name", "go", N, "MESH", "D3")]
    return Grounder(spark, spark.createDataFrame(rows, lexicon.TERMS), models=models)


def models(spark):
    rows = [("ER", "adeft", "HGNC:1", N, 0.0), ("ER", "adeft", "GO:2", N, 0.0), ("ER", "adeft", "HGNC:1", "estrogen", 5.0), ("ER", "adeft", "GO:2", "membrane", 5.0)]
    # the id of a label is what follows its first colon
    rows = [(a, b, c.replace("GO:2", "GO:GO:2"), d, e) for a, b, c, d, e in rows]
    return spark.createDataFrame(rows, "surface string, kind string, label string, feature string, weight double")


def test_annotate_in_context(spark):
    docs = spark.createDataFrame([(1, "The estrogen ER."), (2, "The membrane ER."), (3, "ER kinase"), (4, "")], "id long, text string")
    g = grounder(spark, models(spark))
    found = {(r.id, r.raw): r for r in annotation.annotate(docs, g).collect()}
    assert (found[1, "ER"].db, found[2, "ER"].db) == ("HGNC", "GO") and len(found[1, "ER"].matches) == 2
    assert found[3, "kinase"].others == ["mesh:D3"] and len(found) == 4
    other = docs.withColumn("about", F.lit("membrane"))
    assert {r.db for r in annotation.annotate(other, g, context="about").filter("raw = 'ER'").collect()} == {"GO"}
    assert {r.db for r in annotation.annotate(docs, grounder(spark)).filter("raw = 'ER'").collect()} <= {"HGNC", "GO"}
    flat = {r.id: r for r in annotation.annotation_rows(annotation.annotate(docs, g)).filter("text = 'kinase'").collect()}[3]
    assert flat.asDict().keys() == {"id", "start", "end", "text", "grounding", "standard_name", "score", "additional_groundings", "url"}
    assert (flat.grounding, flat.additional_groundings, flat.url) == ("go:3", "mesh:D3", "https://bioregistry.io/go:3") and re.fullmatch(r"\d\.\d{4}", flat.score)
    assert '"matches":[{' in annotation.annotation_json(annotation.annotate(docs, g)).first().json


def test_no_text_is_broadcast(spark, tmp_path):
    """Each broadcast of the plans is of the models' or the index's columns."""
    spark.createDataFrame([(i, f"the er with for {i} " * 50) for i in range(50)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    from vocabrook.plans import queries

    def ran(df):  # adaptive execution decides while a query runs
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    plan = ran(queries.disambiguate(spark, str(tmp_path)))
    g = grounder(spark)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    index = lexicon_ops.prefix_index(g.terms)
    plan += ran(annotation.candidates(annotation.tokens(docs, "text", "doc_id"), index))
    plan += ran(g.lookup(docs.select(F.col("text").alias("raw"))))
    assert "isFinalPlan=true" in plan
    for block in re.split(r"BroadcastExchange", plan)[1:]:
        depth_of_child = block.split("\n")[1]
        assert "text#" not in depth_of_child and "context#" not in depth_of_child and "token#" not in depth_of_child


def test_training_texts(spark):
    papers = spark.createDataFrame([("ER", i, "a" if i % 2 else "b") for i in range(12)] + [("ER", 1, "b"), ("X", 50, "a")], "surface string, pmid int, label string")
    texts = spark.createDataFrame([(i, f"text number {i} " * 3) for i in range(12)] + [(50, "x")], "pmid int, text string")
    got = disambiguation.training_texts(papers, texts)
    counts = {(r.surface, r.label): r.n for r in got.groupBy("surface", "label").agg(F.count("*").alias("n")).collect()}
    assert counts == {("ER", "a"): 6, ("ER", "b"): 6}  # paper 1 is of both labels; the five others of a are cut to six
    assert disambiguation.enough_texts(spark.createDataFrame([("s", "l", "abcdefgh")], "surface string, label string, text string"), 4).count() == 4


def test_training(spark):
    rows = [(f"estrogen hormone {i % 3}", "a") for i in range(15)] + [(f"membrane organelle {i % 3}", "b") for i in range(15)]
    model, f1 = disambiguation.train(spark.createDataFrame(rows, "text string, label string"), folds=2)
    assert f1 > 0.9 and model.transform(spark.createDataFrame([("hormone estrogen", "a")], "text string, label string")).count() == 1


def test_equivalents_and_members(spark):
    c = spark.createDataFrame([("UP:1",), ("GO:1",)], "curie string")
    links = spark.createDataFrame([("UP:1", "HGNC:5"), ("UP:1", "HGNC:5"), ("ZZ:1", "Q:1")], "curie string, other string")
    assert {r.curie: r.equivalents for r in evaluation.equivalents(c, links, links).collect()} == {"UP:1": ["HGNC:5", "UP:1"], "GO:1": ["GO:1"]}
    members = spark.createDataFrame([("F", "HGNC", "1"), ("F", "HGNC", "2"), ("F", "UP", "3")], "family string, db string, id string")
    current = spark.createDataFrame([("1", "1"), ("2", "9"), ("3", N)], "id string, current_id string")
    assert evaluation.family_members(members, current).first().members == ["HGNC:1", "HGNC:9"]
    nodes = spark.createDataFrame([("a", ["MESH:D1", "X:1"]), ("b", ["MESH:D1", "MESH:D2"]), ("c", ["MESH:D9"])], "id string, xrefs array<string>")
    known = spark.createDataFrame([("D1",)], "id string")
    assert [tuple(r) for r in evaluation.single_xrefs(nodes, known=known).collect()] == [("a", "MESH:D1")]


def test_tables(spark):
    rows = spark.createDataFrame([("A", "X", "t1"), ("A", "X", "t1"), ("A", N, "t2"), ("B", "Y", "t3")], "ref_ns string, pred_ns string, text string")
    assert evaluation.unique_mapping_table(rows, values=["X", "Y"], total=True).filter("ref_ns = 'Total'").first().Total == 2
    m = spark.createDataFrame([("g", "correct", 6), ("g", "unknown", 2), ("g", "wrong", 2)], "gold string, predicted string, n long")
    assert tuple(evaluation.bounds(m).first()) == (10, 0.6, 0.8)
    conf = spark.createDataFrame([("a", "a"), ("a", N)], "gold string, predicted string")
    assert evaluation.confusion(conf, classes=["a", "unknown"]).first().asDict() == {"gold": "a", "a": 1, "unknown": 1}
    gold = spark.createDataFrame([("d", "a", 0, 1), ("d", "b", 2, 3)], "doc string, text string, start int, end int")
    assert [r.text for r in evaluation.false_negatives(gold, gold.filter("text = 'a'")).collect()] == ["b"]
    liked = spark.createDataFrame([(["10090", "1", "9606"],)], "o array<string>")
    assert liked.select(evaluation.organism_order(F.col("o"), ["9606", "10090"])).first()[0] == ["9606", "10090"]
    hist = spark.createDataFrame([(0.71,), (0.72,), (0.9,)], "f1 double")
    assert [(round(r.bin, 2), r.n) for r in evaluation.model_histogram(hist).collect()] == [(0.7, 2), (0.9, 1)]
    assert evaluation.sampled(hist, 2).count() == 2


def test_fragment_mappings(spark):
    fragments = spark.createDataFrame([("alpha chain", "P1#PRO_1", "Human"), ("beta", "P2#PRO_2", "Mouse"), ("gamma", "P3", "Human")], "synonym string, id string, organism string")
    terms = etl.fragment_terms(fragments)
    assert [(r.text, r.id) for r in terms.collect()] == [("alpha chain", "PRO_1")]
    synonyms = spark.createDataFrame([("alpha chain (human)", "PR:1", 0), ("nothing", "PR:2", 1)], "synonym string, id string, ord int")
    names = spark.createDataFrame([("PR:1", "alpha")], "id string, name string")
    (r,) = etl.fragment_mappings(synonyms, names, Grounder(spark, terms)).collect()
    assert (r.source_id, r.target_id, r.relation, r.confidence) == ("PR:1", "PRO_1", "skos:exactMatch", 0.8)


def test_families_and_mappings(spark, tmp_path):
    groups = spark.createDataFrame([(["abc1", "abc2"],), (["a", "b"],)], "names array<string>")
    assert lexicon_ops.find_families(groups).count() == 1
    m = spark.createDataFrame([("D2", "GO", "1"), ("D1", "MESH", "2")], "source_id string, db string, id string")
    lexicon_ops.write_mappings(m, str(tmp_path / "m"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "m"), sep="\t").collect()] == [("D2", "GO", "1")]


def test_lookup_stream(spark, tmp_path):
    from vocabrook.streaming import ground_stream

    src = str(tmp_path / "in")
    spark.createDataFrame([("kinase",), ("zzz",)], "raw string").write.parquet(src)
    stream = ground_stream.lookup_stream(spark.readStream.schema("raw string").parquet(src), grounder(spark))
    q = stream.writeStream.format("memory").queryName("looked_up").start()
    q.processAllAvailable()
    q.stop()
    assert {r.raw for r in spark.table("looked_up").collect()} == {"kinase"}
