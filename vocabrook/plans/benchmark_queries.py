"""Queries of set containment, comparison bounds, span evaluation, descent and context models over the driver's tables.

As in source_queries, derived rows are written once in SQL that Spark and DuckDB read alike; what is computed from them is
written twice, here by the library's operators and in benchmark_oracles in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import annotation, disambiguation, evaluation, learning, lexicon_ops, sentences, set_join
from ..operators.grounding import Grounder, context_key
from ..sources import lexicon
from ..sources.tables import reused
from . import derived, source_queries

INPUTS = {
    "order_parts": "SELECT l_orderkey AS needle, l_partkey AS item FROM {lineitem}",
    "customer_parts": "SELECT o_custkey AS hay, l_partkey AS item FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey",
    "gold_curies": """SELECT c_custkey AS doc, 'HGNC:' || (c_custkey % 40) AS curie FROM {customer}
        UNION ALL SELECT c_custkey, 'UP:' || ((c_custkey * 7) % 50) FROM {customer} WHERE c_custkey % 3 > 0
        UNION ALL SELECT c_custkey, 'HGNC:' || ((c_custkey + 1) % 40) FROM {customer} WHERE c_custkey % 5 = 0""",
    "curie_links": """SELECT DISTINCT 'UP:' || (s_suppkey % 50) AS curie, 'HGNC:' || (s_suppkey % 25) AS other FROM {supplier}
        UNION ALL SELECT DISTINCT 'HGNC:' || (p_size % 40), 'MESH:D' || (p_size % 13) FROM {part} WHERE p_partkey % 2 = 0""",
    "family_members": """SELECT 'F' || n_nationkey AS family, 'HGNC:' || (n_nationkey % 40) AS member FROM {nation}
        UNION ALL SELECT 'F' || n_nationkey, 'HGNC:' || ((n_nationkey + 1) % 40) FROM {nation} WHERE n_nationkey % 2 = 0
        UNION ALL SELECT 'F' || n_nationkey, 'MESH:D' || (n_nationkey % 13) FROM {nation} WHERE n_nationkey % 3 = 0""",
    "curation": """SELECT p_partkey AS ord, p_name AS Text, p_brand AS EntityType, p_type AS Sentence, CASE WHEN p_partkey % 1777 = 1776 THEN NULL ELSE CAST(p_partkey % 3 % 2 AS STRING) END AS Grounding,
        CASE WHEN p_partkey % 4 > 0 THEN 'GO' END AS DB_Ns1, CASE WHEN p_partkey % 4 > 0 THEN 'GO:GO:' || p_size END AS DB_Id1, CASE WHEN p_partkey % 5 = 1 THEN 'PUBCHEM' END AS DB_Ns2,
        CASE WHEN p_partkey % 5 = 1 THEN CAST(p_size % 20 AS STRING) END AS DB_Id2, CASE WHEN p_partkey % 7 = 1 THEN 'CHEBI' END AS DB_Ns3, CASE WHEN p_partkey % 7 = 1 THEN 'C' || p_size END AS DB_Id3 FROM {part}""",
    "pubchem": "SELECT DISTINCT CAST(p_size % 20 AS STRING) AS id, 'CHEBI:' || (p_size % 20) AS chebi_id FROM {part} WHERE p_size % 20 < 12",
    "told": """SELECT p_partkey AS ord, CASE p_partkey % 3 WHEN 0 THEN 'GO' WHEN 1 THEN 'CHEBI' END AS db,
        CASE p_partkey % 3 WHEN 0 THEN 'GO:' || (p_size - p_partkey % 2) WHEN 1 THEN 'CHEBI:' || (p_size % 20) END AS id FROM {part}""",
    "assertions": "SELECT p_name AS text, 'GO' AS db, 'GO:' || (p_size - 1) AS id, p_partkey % 2 = 0 AS right FROM {part} WHERE p_partkey % 10 = 3",
    "gold_spans": """SELECT l_orderkey % 400 AS doc, l_linenumber AS figure, l_returnflag AS text, l_suppkey % 9 AS start, l_suppkey % 9 + 4 AS stop, 'A:' || (l_partkey % 12) AS c1, 'A:' || (l_partkey % 7) AS c2 FROM {lineitem} WHERE l_quantity < 25""",
    "found_spans": """SELECT l_orderkey % 400 AS doc, l_linenumber AS figure, l_returnflag AS text, l_suppkey % 9 AS start, l_suppkey % 9 + 4 AS stop, 'A:' || (l_partkey % 10) AS m1,
        CASE WHEN l_partkey % 2 = 0 THEN 'A:' || (l_partkey % 5) END AS m2 FROM {lineitem} WHERE l_quantity > 15""",
    "tree": """SELECT 'D' || p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'D12.776.' || p_size WHEN 1 THEN 'D08.811.' || p_size || '.1' WHEN 2 THEN 'D12.7760.' || p_size WHEN 3 THEN 'C04.' || p_size ELSE 'D08.811' END AS tree_number FROM {part}
        UNION ALL SELECT 'D' || p_partkey, 'D02.' || p_size FROM {part} WHERE p_partkey % 3 = 0""",
}


def given(spark, sf_dir: str, name: str) -> DataFrame:
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("part", "nation", "supplier", "lineitem", "orders", "customer")}
    return spark.sql(INPUTS[name].format(**tables))


def sets_contained(spark, sf_dir):
    """Orders all of whose parts a customer has bought, whoever's order it is."""
    return set_join.contained_sets(given(spark, sf_dir, "order_parts"), given(spark, sf_dir, "customer_parts"))


def synonym_sets(spark, sf_dir):
    golds = given(spark, sf_dir, "gold_curies").groupBy("doc").agg(F.sort_array(F.collect_set("curie")).alias("curies"))
    found = set_join.synonym_sets(golds, [given(spark, sf_dir, "curie_links")], given(spark, sf_dir, "family_members"))
    return found.select(F.array_join("curies", ",").alias("curies"), F.array_join("synonyms", ",").alias("synonyms"))


def _curated(spark, sf_dir):
    rows = lexicon.curated_groundings(given(spark, sf_dir, "curation"), given(spark, sf_dir, "pubchem"))
    rows = rows.join(given(spark, sf_dir, "told"), "ord")
    return evaluation.new_status(rows, given(spark, sf_dir, "assertions")).withColumn("old", evaluation.old_status())


def curated_rows(spark, sf_dir):
    refs = F.array_join(F.transform(F.array_sort(F.map_entries("db_refs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return _curated(spark, sf_dir).select("ord", "text", "old", "new", refs.alias("db_refs"))


def curated_matrix(spark, sf_dir):
    return evaluation.comparison_matrix(_curated(spark, sf_dir))


def curated_bounds(spark, sf_dir):
    out = evaluation.comparison_bounds(evaluation.comparison_matrix(_curated(spark, sf_dir)))
    return out.select("trial", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def ner_evaluation(spark, sf_dir):
    gold = given(spark, sf_dir, "gold_spans").withColumn("curies", F.array("c1", "c2"))
    found = given(spark, sf_dir, "found_spans").withColumn("matches", F.array_compact(F.array("m1", "m2")))
    out = evaluation.ner_evaluation(gold, found, ("doc", "figure", "text", "start", "stop"))
    return out.select("match_type", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def mesh_classes(spark, sf_dir):
    return lexicon_ops.mesh_classes(given(spark, sf_dir, "tree"))


def mappings_by_descent(spark, sf_dir):
    """Mappings by priority, the classes that they ask for found by descent."""
    terms = source_queries._terms(spark, sf_dir, "mappable")
    return lexicon_ops.by_priority(lexicon_ops.mapping_candidates(terms), classes=lexicon_ops.mesh_classes(given(spark, sf_dir, "tree")))


#: Words of ASCII letters and digits, as DuckDB cuts them too.
PATTERN = "[a-z0-9]+"


def gram_models(docs: DataFrame) -> DataFrame:
    """Models of the surface 'er' over all words and pairs that every twentieth document or more has, their weights by a rule."""
    grams = docs.select("doc_id", F.explode(F.array_distinct(disambiguation.grams("text", PATTERN))).alias("feature"))
    # a few rows of a count over all texts, which whoever uses the models reads several times
    often = reused(grams.groupBy("feature").agg(F.count("*").alias("df")).join(F.broadcast(docs.agg(F.count("*").alias("n")))).filter("df * 20 >= n"))
    weight = lambda k: (((F.length("feature") * 7 + F.col("df") * k) % 11) - 5) / 4.0
    label = F.explode(F.array(F.struct(F.lit("A:1").alias("label"), weight(1).alias("weight")), F.struct(F.lit("B:1").alias("label"), weight(3).alias("weight")))).alias("x")
    rows = often.select("feature", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"), label).select("feature", "idf", "x.label", "x.weight")
    base = docs.sparkSession.createDataFrame([("A:1", 0.25), ("B:1", -0.125)], "label string, weight double").select(F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("idf"), "label", "weight")
    return rows.unionByName(base).select(F.lit("er").alias("surface"), F.lit("own").alias("kind"), "label", "feature", "weight", "idf")


def model_probabilities(spark, sf_dir):
    """A model of words and pairs, weighted by idf and length, in the context of every document."""
    docs = derived.documents(spark, sf_dir).filter("text is not null and text <> ''").select("doc_id", "text", context_key("text").alias("context_key"))
    asked = docs.select(F.lit("er").alias("raw"), "context_key")
    found = disambiguation.label_probabilities(asked, docs.select("context_key", F.col("text").alias("context")), gram_models(docs), PATTERN).filter("label = 'A:1'")
    return docs.select("doc_id", "context_key").hint("merge").join(found, "context_key").select("doc_id", F.round("probability", 7).alias("probability"))


def models_learned(spark, sf_dir):
    """Models that tell a document's language, one a source, learnt in one plan: labels, features and cross-validated F1."""
    texts = derived.documents(spark, sf_dir).select(F.col("source").alias("surface"), F.col("lang").alias("label"), "text")
    return learning.learn(texts).groupBy("surface", "size").agg(F.countDistinct("label").alias("n_labels"), F.countDistinct("feature").alias("n_features"), F.round(F.first("f1"), 6).alias("f1"))


def abbreviation_scores(spark, sf_dir):
    """How likely each word that stands before a full stop is an abbreviation."""
    found = sentences.abbreviation_scores(sentences.words(derived.documents(spark, sf_dir)))
    return found.withColumn("score", F.round("score", 6) + 0.0)


def annotations_bounded(spark, sf_dir):
    """Annotations with the sentence boundaries that the documents tell, counted a document."""
    docs = derived.documents(spark, sf_dir)
    return annotation.counted(docs, Grounder(spark, derived.word_lexicon(spark, sf_dir)), "text", "doc_id", boundaries=sentences.learned(docs))


def queries() -> dict:
    skip = ("queries", "given", "gram_models")
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in skip}
