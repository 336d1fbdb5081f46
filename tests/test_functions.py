"""Golden values of the text, scoring and CURIE functions."""

import pytest
from pyspark.sql import functions as F

from vocabrook.functions import curie, scoring, text, vocab


def one(spark, values, column):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column).collect()]


def test_depluralize(spark):
    got = one(spark, ["BRAF", "apoptosis", "mosquitoes", "antibodies", "branches", "CDs", "receptors", "kinases"], text.depluralize("x"))
    assert [[tuple(x) for x in g] for g in got] == [
        [("BRAF", "non_plural")], [("apoptosis", "non_plural")], [("mosquito", "plural_oes"), ("mosquitoe", "plural_s")], [("antibody", "plural_ies"), ("antibodie", "plural_s")],
        [("branch", "plural_es"), ("branche", "plural_s")], [("CD", "plural_caps_s")], [("receptor", "plural_s")], [("kinas", "plural_es"), ("kinase", "plural_s")],
    ]


def test_greek_and_numerals(spark):
    assert one(spark, ["interferon-γ"], text.replace_greek_spelled_out("x")) == ["interferon-gamma"]
    assert one(spark, ["interferon-gamma", "theta"], text.replace_greek_uni("x")) == ["interferon-γ", "thη"]
    assert one(spark, ["interferon-beta"], text.replace_greek_latin("x")) == ["interferon-b"]
    assert one(spark, ["xx-1", "xx-10", "x1x", "xx-I", "xx viii", "xx-iX"], text.roman_arabic("x")) == ["xx-I", "xx-X", "x1x", "xx-1", "xx 8", "xx-9"]


def test_normalize(spark):
    assert one(spark, ["Löfgren’s syndrome", "βAR", "a \t b", "K‐ras", None, " x "], text.normalize("x")) == ["lofgren's syndrome", "βar", "a b", "kras", None, " x "]


def test_capitalization(spark):
    assert one(spark, ["A", "BRAF", "abcd", "Abcd", "aBcd", "", "12"], text.capitalization("x")) == ["single_cap_letter", "all_caps", "all_lower", "initial_cap", "mixed", "mixed", "mixed"]
    assert one(spark, ["Abcd", "A"], text.capitalization("x", True)) == ["sentence_initial_cap", "sentence_initial_cap"]


def test_split_preserve_tokens(spark):
    assert one(spark, ["a-b c", "-x"], text.split_preserve_tokens("x")) == [["a", "-", "b", " ", "c"], ["", "-", "x"]]


@pytest.mark.parametrize(("q", "r", "score"), [("k-ras", "K-ras", 0.9443), ("k-ras", "KRAS", 0.8589), ("k-ras", "Kras", 0.9424), ("ras", "RAs", 0.6938), ("ras", "ras", 1.0), ("Ras", "RA-s", 0.9425), ("ras", "RAS", 0.3599), ("receptors", "receptor", 1.0)])
def test_string_score(spark, q, r, score):
    df = spark.createDataFrame([(q, r)], "q string, r string").withColumn("m", scoring.generate_match("q", "r"))
    assert abs(df.select(scoring.score_string_match("m")).first()[0] - score) < 1e-4


def test_match_parts(spark):
    rows = [("BRAF", "Braf"), ("BrAf", "braf"), ("eIF-5A", "EIF5A"), ("a b", "ab")]
    m = [r.m for r in spark.createDataFrame(rows, "q string, r string").select(scoring.generate_match("q", "r").alias("m")).collect()]
    assert [tuple(c) for c in m[0].cap_combos] == [("all_caps", "initial_cap")]
    assert [tuple(c) for c in m[1].cap_combos] == [("mixed", "all_lower")]
    assert m[2].dash_mismatches == ["query"] and ("mixed", "all_caps") in [tuple(c) for c in m[2].cap_combos]
    assert m[3].space_mismatch and not m[3].exact


def test_full_score(spark):
    df = spark.createDataFrame([("mek", "MEK", "curated"), ("mapt", "MAPT", "name")], "q string, r string, s string")
    a, b = [r[0] for r in df.select(scoring.score(scoring.score_string_match(scoring.generate_match("q", "r")), "s")).collect()]
    assert abs(a - 0.9288806431663574) < 1e-12 and abs(b - 0.7623) < 1e-4


def test_curies(spark):
    df = spark.createDataFrame([("UP", "P12345"), ("HGNC", "12345"), ("CHEBI", "CHEBI:12345"), ("X", "a:b:c")], "db string, id string")
    got = df.select(curie.get_bioregistry_url("db", "id"), curie.get_identifiers_url("db", "id")).collect()
    assert [r[0] for r in got] == ["https://bioregistry.io/uniprot:P12345", "https://bioregistry.io/hgnc:12345", "https://bioregistry.io/chebi:12345", None]
    assert got[2][1] == "https://identifiers.org/CHEBI:12345"


def test_protein_names(spark):
    got = one(spark, ["Kinase A (EC 1.2.3.4) (Protein B) (C(D)E)", "X(0)", "Long name [Includes: P1 (EC 1.1.1.1); P2]"], vocab.protein_names("x"))
    assert got == [["Kinase A", "Protein B", "C(D)E"], ["X(0)"], ["Long name"]]


def test_vocabulary_functions(spark):
    assert one(spark, ["Ala-Gly", "ala-gly", "Ala", "Ala-Xyz"], vocab.is_aa_sequence("x")) == [True, False, False, False]
    assert one(spark, ["symbol withdrawn, see [HGNC: 12]", "x"], vocab.withdrawn_to("x")) == ["12", ""]
    assert one(spark, ["Uniprot:P1|GO:0005|CVCL_1|Uberon:UBERON:1"], vocab.normal_ids("x")) == [["UP:P1", "GO:GO:0005", "CVCL:1", "UBERON:1"]]
    assert one(spark, ['a "b"', "x (formerly y)", "Ambiguous z"], vocab.clean_synonym("x")) == ["a ", "x", None]
    assert one(spark, ['"a, b", c', '"x ""y"""', "p,q ", ""], vocab.alias_names("x")) == [["a, b", "c"], ['x "y"'], ["p", "q"], []]
    assert one(spark, ["UP", "HGNC"], vocab.display_name("x")) == ["Uniprot", "HGNC"]
    assert one(spark, ["stereamide", "nmn(abc)", "palmitic_acid", "pipecolicacid", "a/b"], vocab.metabolite_name("x")) == ["stearamide", "nmn", "palmitic acid", "pipecolic acid", "a"]
    assert one(spark, ["a (b)", "a"], vocab.without_suffix("x")) == [["a (b)", "a"], ["a", "a"]]


def test_entity_types(spark):
    df = spark.createDataFrame([(["NCBI gene:1"], ["HGNC:5"]), (["UP:1"], ["UP:1"]), (["GO:1"], None), (["ZZ:1"], ["HGNC:1"])], "ids array<string>, eq array<string>")
    assert [r[0] for r in df.select(vocab.gene_type("ids", "eq")).collect()] == ["Human Gene", "Nonhuman Gene", "Cellular Component", "unknown"]
    p = spark.createDataFrame([(0.5, 1.0), (0.0, 0.0)], "p double, r double")
    assert [round(r[0], 6) for r in p.select(vocab.f1("p", "r")).collect()] == [0.666667, 0.0]


def test_groundings_of_a_match(spark):
    rows = [(("GO", "GO:1", "MESH", "D1"), [("GO", "GO:1", None, None), ("GO", "GO:1", "DOID", "DOID:2")])]
    kind = "struct<db:string,id:string,source_db:string,source_id:string>"
    df = spark.createDataFrame(rows, f"term {kind}, subsumed array<{kind}>")
    g = df.select(curie.match_groundings(F.col("term"), F.col("subsumed")).alias("g"))
    assert [(x.db, x.id) for x in g.first().g] == [("GO", "GO:1"), ("MESH", "D1"), ("DOID", "DOID:2")]
    assert set(g.select(curie.grounding_dict(F.col("g")).alias("d")).first().d) == {"go:1", "mesh:D1", "doid:2"}
