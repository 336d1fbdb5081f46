"""Grounding, lexicon, annotation, ETL and evaluation on small lexicons."""

import pytest
from pyspark.sql import functions as F

from vocabrook.operators import annotation, disambiguation, etl, evaluation, lexicon_ops
from vocabrook.operators.grounding import Grounder, filter_for_organism, match_json
from vocabrook.sources import lexicon

N = None


def terms(spark, *rows):
    return spark.createDataFrame(list(rows), lexicon.TERMS)


@pytest.fixture(scope="module")
def grounder(spark):
    return Grounder(spark, terms(
        spark, ("braf", "BRAF", "HGNC", "1097", "BRAF", "name", "hgnc", "9606", N, N), ("braf", "Braf", "UP", "P28028", "Braf", "name", "uniprot", "10090", N, N),
        ("kinase", "kinase", "MESH", "D010770", "kinase", "name", "mesh", N, N, N), ("mitochondria", "mitochondria", "GO", "GO:0005739", "mitochondrion", "synonym", "go", N, "MESH", "D008928"),
        ("mitochondria", "Mitochondria", "GO", "GO:0005739", "mitochondrion", "name", "go", N, N, N),
    ))


def ask(spark, g, *raw, **options):
    return g.ground(spark.createDataFrame([(r,) for r in raw], "raw string"), **options).orderBy("raw", "rank").collect()


def test_ground_and_organisms(spark, grounder):
    assert [(r.db, r.id) for r in ask(spark, grounder, "BRAF")] == [("HGNC", "1097")]
    assert [(r.db, r.id) for r in ask(spark, grounder, "BRAF", organisms=["10090", "9606"])] == [("UP", "P28028")]
    assert ask(spark, grounder, "xyz") == []
    assert [r.id for r in ask(spark, grounder, " kinases ")] == ["D010770"]


def test_merge_and_namespaces(spark, grounder):
    (r,) = ask(spark, grounder, "mitochondria")
    assert r.term.text == "Mitochondria" and [t.text for t in r.subsumed_terms] == ["mitochondria"] and set(r.namespaces) == {"GO", "MESH"}
    assert len(ask(spark, grounder, "mitochondria", namespaces=["MESH"])) == 1
    assert ask(spark, grounder, "mitochondria", namespaces=["HP"]) == []


def test_json(spark, grounder):
    (r,) = match_json(grounder.ground(spark.createDataFrame([("kinase",)], "raw string"))).collect()
    assert '"organism"' not in r.json and '"subsumed_terms"' not in r.json


@pytest.mark.parametrize(("organisms", "kept"), [(["9606"], {N, "9606"}), (["10090"], {N, "10090"}), (["10090", "9606"], {N, "10090"}), (["9606", "10090"], {N, "9606"})])
def test_organism_filter(spark, organisms, kept):
    df = spark.createDataFrame([("q", "9606"), ("q", "10090"), ("q", N)], "raw string, organism string")
    assert {r.organism for r in filter_for_organism(df, organisms).collect()} == kept


def test_ground_column_and_lists(spark, grounder):
    df = spark.createDataFrame([(1, "BRAF"), (2, "nothing"), (3, N), (4, "BRAF")], "k int, t string")
    assert {r.k: r.t_grounded for r in grounder.ground_column(df, "t").collect()} == {1: "hgnc:1097", 2: N, 3: N, 4: "hgnc:1097"}
    (r,) = grounder.ground_lists(spark.createDataFrame([(1, ["kinase", "zzz"])], "k int, xs array<string>"), "k", "xs").collect()
    assert "D010770" in r.matches[0] and r.matches[1] == "[]"


def test_constructors(spark):
    row = ("a", "a", "X", "1", "a", "name", "x", N, N, N)
    for t in ([row], (row,), {row}, iter([row]), {"a": [row]}):
        assert lexicon.load(spark, t).count() == 1
    with pytest.raises(TypeError):
        lexicon.load(spark, 4)


def test_round_trip(spark, tmp_path):
    t = terms(spark, ("na", "NA", "X", "1", 'say "hi"', "name", "x ", N, N, N), ("b\t", " b\t", "X", "2", "b", "name", "x", "9606", "Y", "3"))
    lexicon.write_terms(t, str(tmp_path / "t.tsv.gz"), 1)
    assert set(map(tuple, lexicon.read_terms(spark, str(tmp_path / "t.tsv.gz")).collect())) == set(map(tuple, t.collect()))


def test_dedupe_and_catalogue(spark):
    t = terms(
        spark, ("a", "a", "MESH", "1", "a", "former_name", "mesh", N, N, N), ("a", "a", "MESH", "1", "a", "synonym", "x", N, N, N), ("b", "b", "MESH", "2", "b", "synonym", "x", N, N, N), ("b", "b", "MESH", "2", "b", "synonym", "mesh", N, N, N),
        ("a", "a", "GO", "9", "z", "synonym", "go", N, N, N),
    )
    got = {(r.text, r.db): (r.status, r.source) for r in lexicon_ops.filter_out_duplicates(t).collect()}
    assert got == {("a", "MESH"): ("synonym", "x"), ("b", "MESH"): ("synonym", "mesh"), ("a", "GO"): ("synonym", "go")}
    assert [r.text for r in lexicon_ops.ambiguities(t).collect()] == ["a"]
    assert [r.lengths for r in lexicon_ops.prefix_index(t).orderBy("first_word").collect()] == [[1], [1]]
    table = lexicon.TermTable(t)
    assert len(table) == 2 and table.get("b").count() == 2
    with pytest.raises(KeyError):
        table["zz"]


def test_common_prefix(spark):
    df = spark.createDataFrame([(["abcd", "abce", "abc"],), (["x"],), (["ab", "cd"],)], "names array<string>")
    assert [r[0] for r in df.select(lexicon_ops.common_prefix_length(F.col("names"))).collect()] == [3, 1, 0]


def test_mappings(spark):
    m = spark.createDataFrame([("D1", "x", "GO", "1", "x"), ("D1", "x", "GO", "2", "y"), ("D2", "q", "GO", "3", "r"), ("D3", "a", "GO", "4", "b"), ("D4", "c", "GO", "4", "d")], "source_id string, source_name string, db string, id string, name string")
    one = lexicon_ops.one_to_one(m)
    assert {(r.source_id, r.id) for r in one.collect()} == {("D1", "1"), ("D2", "3")}
    pos = spark.createDataFrame([("D2", "HP", "7")], "source_id string, db string, id string")
    neg = spark.createDataFrame([("D1", "GO", "1")], "source_id string, db string, id string")
    assert {tuple(r) for r in lexicon_ops.with_overrides(one, pos, neg).collect()} == {("D2", "HP", "7")}


def test_annotate_and_brat(spark, grounder):
    s = "This is about BRAF. A kinase, and BRAF kinases."
    docs = spark.createDataFrame([(1, s), (2, ""), (3, N)], "id long, text string")
    found = annotation.annotate(docs, grounder)
    rows = found.orderBy("start").collect()
    assert [(r.start, r.end, r.raw) for r in rows] == [(14, 18, "BRAF"), (22, 28, "kinase"), (34, 38, "BRAF")]
    assert all(s[r.start : r.end] == r.raw for r in rows)
    (b,) = annotation.brat(found).collect()
    assert b.brat.startswith("T1\tEntity 14 18\tBRAF\n#1\tAnnotatorNotes T1\thgnc:1097\n") and b.brat.count("\n") == 6
    html = {r.id: r.html for r in annotation.annotated_html(docs, found).collect()}
    assert '<span class="match" title="hgnc:1097">BRAF</span>' in html[1]


def test_leftmost_longest(spark):
    df = spark.createDataFrame([(1, 0, 0, 1, "a"), (1, 0, 0, 2, "a b"), (1, 0, 1, 2, "b c"), (1, 0, 2, 1, "c")], "id int, sent int, idx int, span int, raw string")
    assert [r.raw for r in annotation.leftmost_longest(df).orderBy("idx").collect()] == ["a b", "c"]


def test_disambiguation(spark, grounder):
    models = spark.createDataFrame([("BRAF", "adeft", "HGNC:1097", N, 1.0), ("BRAF", "adeft", "ungrounded", N, 0.0), ("BRAF", "adeft", "HGNC:1097", "gene", 2.0)], "surface string, kind string, label string, feature string, weight double")
    g = Grounder(spark, grounder.terms, models=models)
    df = spark.createDataFrame([("BRAF", "the gene here")], "raw string, c string")
    (r,) = g.ground(df, context="c").collect()
    assert abs(r.disambiguation.score - 0.9525741268) < 1e-9 and r.disambiguation.match == "grounded" and r.score < 0.9526
    assert [x.surface for x in g.get_models().collect()] == ["BRAF"]
    assert disambiguation.unique_pmids(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "pmid int, label string")).count() == 1


def test_etl(spark):
    rows = spark.createDataFrame([("HGNC:1097", "BRAF", "B-Raf", "Approved", "BRAF1, RAFB1", "", '"v-raf, homolog", c'), ("HGNC:5", "OLD", "symbol withdrawn, see [HGNC:1097]", "Symbol Withdrawn", "", "", "")], "hgnc_id string, symbol string, name string, status string, aliases string, previous string, alias_names string")
    got = {(r.text, r.status, r.id) for r in etl.hgnc_terms(rows).collect()}
    assert got == {("BRAF", "name", "1097"), ("B-Raf", "name", "1097"), ("BRAF1", "synonym", "1097"), ("RAFB1", "synonym", "1097"), ("v-raf, homolog", "synonym", "1097"), ("c", "synonym", "1097"), ("OLD", "former_name", "1097")}
    go = spark.createDataFrame([("GO:1", "x activity", ["x", "y activity"])], "id string, name string, synonyms array<string>")
    assert {r.text for r in etl.go_terms(go).collect()} == {"x activity", "y activity"}
    up = spark.createDataFrame([("P1", "G1", "G2 G3", "Prot one (Prot two)", "10090"), ("P2", "A; B", "; C", "Many", "9606"), ("P15056", "BRAF", "BRAF1", "Raf (EC 2.7.11.1)", "9606")], "entry string, primary string, synonyms string, names string, organism string")
    genes = spark.createDataFrame([("P15056", "1097", "BRAF")], "entry string, hgnc_id string, symbol string")
    got = {(r.id, r.text, r.status) for r in etl.uniprot_terms(up, genes).collect()}
    assert {("P1", "G1", "name"), ("P1", "Prot one", "synonym"), ("P1", "G3", "synonym"), ("P2", "Many", "name"), ("1097", "Raf", "synonym"), ("1097", "BRAF1", "synonym")} <= got and ("P2", "C", "synonym") not in got
    mesh = spark.createDataFrame([("D1", "m", "n|o"), ("D2", "z", N)], "id string, name string, synonyms string")
    fwd = spark.createDataFrame([("D1", "GO", "GO:1", "gm")], "mesh_id string, db string, id string, name string")
    assert {(r.text, r.db, r.status) for r in etl.mesh_terms(mesh, fwd).collect()} == {("m", "GO", "synonym"), ("n", "GO", "synonym"), ("o", "GO", "synonym"), ("z", "MESH", "name")}
    assert etl.all_terms(etl.go_terms(go), etl.go_terms(go)).count() == 2


def test_obo_cascade(spark):
    e = spark.createDataFrame([("X:1", "one", ["uno", "ambiguous y"], [("MESH", "D1")]), ("X:2", "two", [], [("DOID", "5")]), ("X:3", "three", [], [])], "id string, name string, synonyms array<string>, xrefs array<struct<namespace:string,id:string>>")
    names = spark.createDataFrame([("D1", "mesh one")], "mesh_id string, mesh_name string")
    fwd = spark.createDataFrame([], "mesh_id string, db string, id string, name string")
    rev = spark.createDataFrame([("HP", "X:3", "D9", "mesh three")], "db string, id string, mesh_id string, mesh_name string")
    doid = spark.createDataFrame([("DOID:5", "disease five", N)], "doid string, doid_name string, primary string")
    got = {(r.text, r.db, r.id, r.source_id) for r in etl.obo_terms(e, "hp", names, fwd, rev, doid).collect()}
    assert got == {("one", "MESH", "D1", "X:1"), ("uno", "MESH", "D1", "X:1"), ("two", "DOID", "DOID:5", "X:2"), ("three", "MESH", "D9", "X:3")}


def test_evaluation(spark):
    gold = spark.createDataFrame([("d", "a", 0, 1), ("d", "b", 2, 3)], "doc string, text string, start int, end int")
    found = spark.createDataFrame([("d", "a", 0, 1), ("d", "c", 5, 6)], "doc string, text string, start int, end int")
    r = evaluation.annotation_counts(gold, found).first()
    assert (r.tp, r.fp, r.fn, r.f1) == (1, 1, 1, 0.5)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "child string, parent string")
    assert evaluation.closure(edges).count() == 6
    rows = spark.createDataFrame([(["A:1"], ["B:1", "A:1"], N), (["A:1"], [], ["B:1"])], "gold array<string>, groundings array<string>, equivalents array<string>")
    assert [(x.top_correct, x.exists_correct) for x in evaluation.correctness(rows).collect()] == [(False, True), (False, False)]


def test_streaming_matches_batch(spark, grounder, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    spark.createDataFrame([("BRAF",), ("none",)], "raw string").write.parquet(src)
    from vocabrook.streaming.ground_stream import ground_batches

    q = ground_batches(spark.readStream.schema("raw string").parquet(src), grounder, out, ck)
    q.awaitTermination(120)
    assert {(r.raw, r.raw_grounded) for r in spark.read.parquet(out).collect()} == {("BRAF", "hgnc:1097"), ("none", None)}


def test_document_queries_read_every_document(spark, tmp_path):
    import math
    import re
    from collections import Counter

    from vocabrook.plans import queries

    letters = ["zentrale", "größe", "café", "forêt", "lumen"]
    texts = {1: ("en", "lumen zentrale the lumen\ncafé " + "lumen zentrale " * 40), 2: ("fr", "forêt café, Café (forêt) " * 21), 3: ("de", "Größe zentrale x größe\n" * 25), 4: (N, "lumen the café"), 5: ("es", N), 6: ("en", ""), 7: ("fr", "forêt")}
    spark.createDataFrame([(d, t, lang) for d, (lang, t) in texts.items()], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    words = {d: [re.findall(r"[^\W\d_]+", line.lower()) for line in (t or "").split("\n")] for d, (_, t) in texts.items()}
    flat = {d: [w for line in lines for w in line] for d, lines in words.items()}
    ones = {w for w, n in Counter(w for x in flat.values() for w in x).items() if len(w) >= 4 and n >= 40}
    twos = {p for p, n in Counter(p for x in flat.values() for p in zip(x, x[1:]) if min(map(len, p)) >= 4).items() if n >= 12}
    assert ones == set(letters)
    want = {}
    for d, lines in words.items():
        for w in lines:
            k = 0
            while k < len(w):
                size = 2 if tuple(w[k : k + 2]) in twos else 1 if w[k] in ones else 0
                want[d] = want.get(d, 0) + (size > 0)
                k += size or 1
    want = {d: n for d, n in want.items() if n}
    assert {r.doc_id: r.n_annotations for r in queries.annotations_all(spark, str(tmp_path)).collect()} == want
    rows = queries.annotations_treebank(spark, str(tmp_path)).collect()
    assert {r.id for r in rows} == set(want) and all(re.sub(r"\W", " ", texts[r.id][1][r.start : r.end]) == r.text for r in rows)
    chance = {}
    for d, (_, t) in texts.items():
        if t:
            w = set(flat[d])
            a, b = math.exp(0.2 + 1.5 * ("the" in w) - 0.5 * ("with" in w)), math.exp(0.1 + 0.7 * ("for" in w))
            chance[d] = round(a / (a + b + 1), 9)
    assert {r.doc_id: r.probability for r in queries.disambiguate_all(spark, str(tmp_path)).collect()} == chance
