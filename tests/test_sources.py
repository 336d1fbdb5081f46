"""Readers and writers, on files written by the test."""

import json

import pytest

from vocabrook.sources import lexicon


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text, newline="")
    return str(tmp_path / name)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_load_dispatch(spark, tmp_path):
    with pytest.raises(ValueError, match="not set"):
        lexicon.load(spark)
    path = write(tmp_path, "t.tsv", "\t".join(lexicon.COLUMNS) + "\na\tA\tX\t1\tA\tname\tx\t\t\t\n")
    spark.conf.set(lexicon.DEFAULT, path)
    try:
        assert lexicon.load(spark).first().text == "A"
    finally:
        spark.conf.unset(lexicon.DEFAULT)
    with pytest.raises(Exception, match="(?i)sqlite|driver"):  # the driver's jar is not part of Spark
        lexicon.load(spark, str(tmp_path / "terms.db"))


def test_delimited(spark, tmp_path):
    hgnc = write(tmp_path, "h.tsv", "HGNC ID\tsym\tname\tst\ta\tp\tn\nHGNC:1\tA\tx \"q\tApproved\t\t\t\"u, v\"\n")
    assert rows(lexicon.read_hgnc(spark, hgnc).select("hgnc_id", "name", "alias_names")) == [("HGNC:1", 'x "q', '"u, v"')]
    mesh = write(tmp_path, "m.tsv", "D1\tone\tuno|eins\nD2\ttwo\t\n")
    assert rows(lexicon.read_mesh(spark, mesh)) == [("D1", "one", "uno|eins"), ("D2", "two", None)]
    up = write(tmp_path, "u.tsv", "e\tp\ts\to\tn\nP1\tA\t\t9606\tn\nP2\tB\t\t10090\tn\n")
    assert rows(lexicon.read_uniprot(spark, up, ["9606"]).select("entry")) == [("P1",)]
    chebi = write(tmp_path, "c.tsv", "i\tc\tt\ts\tn\ta\tl\n1\t15\tx\ty\twater\tF\ten\n")
    assert rows(lexicon.read_chebi_names(spark, chebi)) == [("15", "water")]
    words = write(tmp_path, "w.txt", "the\n\n of \nthe\n")
    assert rows(lexicon.read_words(spark, words)) == [("of",), ("the",)]
    first = write(tmp_path, "f.csv", 'name,x\n"a, b",1\n"a, b",2\nc,3\n')
    assert rows(lexicon.first_fields(spark, first)) == [("a, b",), ("c",)]


def test_ragged_map(spark, tmp_path):
    path = write(tmp_path, "g.csv", 'erk,FPLX,ERK\n"a, b",HGNC,X,UP,P1\nz,,\n')
    got = {r.text: r.groundings for r in lexicon.grounding_map(lexicon.read_ragged(spark, path)).collect()}
    assert got == {"erk": {"FPLX": "ERK"}, "a, b": {"HGNC": "X", "UP": "P1"}, "z": {}}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_obo(spark, tmp_path, end):
    text = """format-version: 1.2

[Term]
id: X:1
name: one
synonym: "uno \\"1\\"" EXACT []
xref: MESH:D1
xref: DOID:DOID:5

[Term]
id: X:2
name: two
is_obsolete: true

[Term]
id: X:3
name: three

[Typedef]
id: part_of
name: part of
"""
    path = write(tmp_path, "x.obo", text.replace("\n", end))
    got = lexicon.read_obo(spark, path)
    assert [(r.id, r.name, len(r.synonyms), [tuple(x) for x in r.xrefs]) for r in got.orderBy("id").collect()] == [("X:1", "one", 1, [("MESH", "D1"), ("DOID", "DOID:5")]), ("X:3", "three", 0, [])]
    assert lexicon.read_obo(spark, path, obsolete=True).count() == 3


def test_json_sources(spark, tmp_path):
    path = write(tmp_path, "a.json", json.dumps([{"id": "GO:1", "name": "n", "synonyms": ["s"]}, {"id": "GO:2", "name": "m"}]))
    assert rows(lexicon.read_json_array(spark, path, "id string, name string, synonyms array<string>").select("id", "synonyms")) == [("GO:1", ["s"]), ("GO:2", None)]
    graph = {"graphs": [{"nodes": [{"id": "x1", "lbl": "a", "meta": {"synonyms": [{"val": "b"}], "xrefs": [{"val": "MESH:D1"}]}}, {"id": "x2"}]}]}
    (r,) = lexicon.read_obo_graph(spark, write(tmp_path, "g.json", json.dumps(graph))).collect()
    assert (r.id, r.name, r.synonyms, r.xrefs[0].namespace) == ("x1", "a", ["b"], "MESH")
    models = {"er": {"stats": {"f1": {"mean": 0.9}}}, "x": {"stats": {"f1": {"mean": 0.5}}}}
    assert rows(lexicon.read_models(spark, write(tmp_path, "m.json", json.dumps(models)))) == [("er", 0.9)]
    assert json.loads(lexicon.terms_to_json(lexicon.load(spark, [("a", "A", "X", "1", "A", "name", "x", None, None, None)])).first().json) == {"norm_text": "a", "text": "A", "db": "X", "id": "1", "entry_name": "A", "status": "name", "source": "x"}


def test_xml_sources(spark, tmp_path):
    bioc = """<collection><document><id>12 x</id><passage><offset>5</offset><text>p</text><annotation id="1"><infon key="type">Gene</infon><location offset="7" length="4"/><text>BRAF</text></annotation></passage></document></collection>"""
    assert rows(lexicon.read_bioc(spark, write(tmp_path, "b.xml", bioc))) == [("12", 5, "BRAF", "Gene", 7, 11)]
    write(tmp_path, "77.xml", "<d><text>One <b>two</b> &lt; 3</text><x>no</x><text>four</text></d>")
    assert rows(lexicon.read_full_text(spark, str(tmp_path / "77.xml"))) == [("77", "One two < 3\nfour\n")]


def test_corpora(spark, tmp_path):
    path = write(tmp_path, "b.csv", "text,obj,don_article\nBRAF,NCBI gene:673,1\nzz,ABC:1,1\nerk,Uniprot:P1|GO:0005,2\n")
    got = {r.text: (r.obj, r.entity_type) for r in lexicon.read_bioid(spark, path).collect()}
    assert got == {"BRAF": (["NCBI gene:673"], "Gene"), "erk": (["UP:P1", "GO:GO:0005"], "Gene")}
    docs = spark.createDataFrame([("d", [(0, 3, "abc", "T1,T2", "C1")])], "id string, entities array<struct<start_index:int,end_index:int,text_segment:string,semantic_type_id:string,entity_id:string>>")
    assert lexicon.medmentions(docs).first().semantic_types == ["T1", "T2"]
    curated = spark.createDataFrame([("a", "x", 1), ("b", None, 2), ("c", "y", 3)], "t string, v string, ord int")
    assert rows(lexicon.before_first_null(curated, "v").select("t")) == [("a",)]
    pairs = spark.createDataFrame([("skos:exactMatch", "mesh", "D1", "doid", "5"), ("skos:exactMatch", "go", "7", "mesh", "D2"), ("other", "mesh", "D3", "go", "1")], "relation string, source_prefix string, source_id string, target_prefix string, target_id string")
    assert rows(lexicon.oriented_mappings(pairs)) == [("D1", "DOID", "5"), ("D2", "GO", "7")]
    maps = spark.createDataFrame([("MESH", "D1", "m", "GO", "1", "g", 1), ("MESH", "D1", "m", "GO", "2", "h", 2)], "mesh_db string, mesh_id string, mesh_name string, db string, id string, name string, ord int")
    forward, reverse = lexicon.mapping_table(maps)
    assert rows(forward) == [("D1", "GO", "2", "h")] and reverse.count() == 2


def test_own_vocabulary_and_table(spark):
    v = spark.createDataFrame([("1", "Heart", ["heart", "cor"]), ("2", "", ["x"])], "id string, name string, synonyms array<string>")
    t = lexicon.name_synonym_terms(v, "UBERON", organism="9606")
    assert {(r.text, r.status, r.norm_text, r.entry_name, r.source) for r in t.filter("id = '1'").collect()} == {("Heart", "name", "heart", "Heart", "uberon"), ("heart", "synonym", "heart", "Heart", "uberon"), ("cor", "synonym", "cor", "Heart", "uberon")}
    bad = lexicon.load(spark, [(" ", "x", "X", "1", "x", "name", "x", None, None, None), ("a", "a", "X", "1", "x", "name", "x", None, None, None)])
    assert lexicon.rejected(bad).count() == 1 and lexicon.valid(bad).count() == 1
    spark.sql("DROP TABLE IF EXISTS lex_t")
    lexicon.build_table(t.filter("text <> ''"), "lex_t", 4)
    try:
        from pyspark.sql import functions as F

        from vocabrook.operators.grounding import Grounder

        g = Grounder(spark, "lex_t")
        plan = g.lookup(spark.createDataFrame([("cor",)], "raw string"))._jdf.queryExecution().executedPlan().toString()
        scan = plan[plan.index("lex_t") - 400 :]
        assert "Bucketed: true" in scan or "SelectedBucketsCount" in scan
        assert [r.id for r in g.ground(spark.createDataFrame([("cor",)], "raw string"), organisms=["9606"]).select(F.col("id")).collect()] == ["1"]
        assert g.get_names("UBERON", "1", status="name").collect()[0].text == "Heart" and g.get_models().count() == 0
    finally:
        spark.sql("DROP TABLE lex_t")
