"""Queries of vocabulary sources, catalogues, mappings and context models over rows derived from the driver's tables.

The derived rows are written once, in SQL that Spark and DuckDB read alike ({part} etc. stand for the tables); what is
computed from them is written twice: as the library's operators here, and as DuckDB SQL in source_oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import annotation, disambiguation, etl, evaluation, lexicon_ops
from ..operators.grounding import Grounder, context_key
from ..sources import lexicon
from . import derived

#: Rows of each source. Lists are texts with separators, as in the files.
INPUTS = {
    "hgnc": """SELECT 'HGNC:' || p_partkey AS hgnc_id, CASE WHEN p_partkey % 7 = 0 THEN 'OLD' || p_partkey ELSE 'G' || (p_partkey % 90) || upper(substr(p_brand, 7, 2)) END AS symbol,
        CASE WHEN p_partkey % 7 = 0 THEN 'symbol withdrawn, see [HGNC:' || (p_partkey + 1) || ']' WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS name,
        CASE WHEN p_partkey % 7 = 0 THEN 'Symbol Withdrawn' WHEN p_partkey % 13 = 0 THEN 'Entry Withdrawn' ELSE 'Approved' END AS status,
        CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) || ', ' || p_brand ELSE '' END AS aliases, CASE WHEN p_partkey % 3 = 0 THEN 'P' || p_size ELSE '' END AS previous,
        CASE WHEN p_partkey % 5 = 0 THEN '"' || p_type || ', ' || p_brand || '", ' || p_brand WHEN p_partkey % 5 = 1 THEN '"' || p_name || '"' ELSE '' END AS alias_names FROM {part}""",
    "chebi": """SELECT 'CHEBI:' || p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'Ala-Gly-' || CASE WHEN p_partkey % 8 = 0 THEN 'Lys' ELSE 'lys' END ELSE p_name END AS name,
        CASE p_partkey % 3 WHEN 0 THEN lower(p_brand) || '|' || p_type || '|' || p_type WHEN 1 THEN 'ambiguous ' || p_type ELSE '' END AS synonyms FROM {part} WHERE p_partkey % 5 > 0""",
    "chebi_names": """SELECT p_partkey AS compound_id, CASE WHEN p_partkey % 2 = 0 THEN 'AGK' ELSE 'agk ' || p_size END AS name FROM {part}
        UNION ALL SELECT p_partkey, p_name FROM {part} WHERE p_partkey % 3 = 0""",
    "chebi_primary": "SELECT p_partkey AS compound_id, p_partkey + 1 AS primary_id FROM {part} WHERE p_partkey % 10 = 0",
    "mesh": """SELECT 'D' || p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) || '|' || p_brand ELSE '' END AS synonyms FROM {part}""",
    "forward": """SELECT 'D' || p_partkey AS mesh_id, CASE p_partkey % 6 WHEN 0 THEN 'EFO' WHEN 1 THEN 'HP' WHEN 2 THEN 'DOID' WHEN 3 THEN 'GO' ELSE 'CHEBI' END AS db,
        'T:' || p_size || '_' || p_partkey AS id, upper(p_brand) AS name FROM {part} WHERE p_partkey % 2 = 0 OR p_partkey % 9 = 0""",
    "go": """SELECT 'GO:' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' activity' ELSE p_name END AS name,
        CASE WHEN p_partkey % 3 = 0 THEN p_name || '|' || p_brand || ' activity' WHEN p_partkey % 3 = 1 THEN p_type ELSE '' END AS synonyms FROM {part}""",
    "famplex": """SELECT p_name AS text, CASE p_partkey % 8 WHEN 0 THEN 'FPLX|F' || p_size || '|HGNC|x' WHEN 1 THEN 'HGNC|S' || (p_partkey % 40) WHEN 2 THEN 'UP|U' || (p_partkey % 40) || '|MESH|D1'
        WHEN 3 THEN 'CHEBI|CHEBI:' || p_size WHEN 4 THEN 'GO|GO:' || p_size WHEN 5 THEN 'MESH|D' || p_partkey WHEN 6 THEN 'PUBCHEM|1' ELSE 'MESH|D' || (p_partkey + 2) END AS pairs FROM {part}""",
    "genes": "SELECT DISTINCT 'S' || (p_partkey % 40) AS symbol, CAST(p_partkey % 40 AS STRING) AS hgnc_id FROM {part} WHERE p_partkey % 40 > 9",
    "proteins": "SELECT DISTINCT 'U' || (p_partkey % 40) AS entry, CASE WHEN p_partkey % 4 = 2 THEN CAST(p_partkey % 40 AS STRING) END AS hgnc_id, CASE WHEN p_partkey % 4 = 2 THEN 'S' || (p_partkey % 40) END AS symbol FROM {part} WHERE p_partkey % 40 > 19",
    "labels_of": "SELECT DISTINCT 'CHEBI' AS db, 'CHEBI:' || p_size AS id, 'chem ' || p_size AS name FROM {part} UNION ALL SELECT DISTINCT 'MESH', 'D' || p_partkey, 'mesh ' || p_partkey FROM {part} WHERE p_partkey % 3 > 0",
    "uniprot": """SELECT 'Q' || p_partkey AS entry, CASE WHEN p_partkey % 5 = 0 THEN 'A' || p_size || '; B' || p_size WHEN p_partkey % 7 = 0 THEN '' ELSE 'A' || p_size END AS primary,
        CASE WHEN p_partkey % 3 = 0 THEN 'x' || p_size || ' y' || p_size ELSE '' END AS synonyms, p_name || ' (' || p_brand || ') (EC 1.2.3.' || p_size || ')' AS names,
        CASE WHEN p_partkey % 2 = 0 THEN '9606' ELSE '10090' END AS organism FROM {part}""",
    "gene_of": "SELECT 'Q' || p_partkey AS entry, CAST(p_size AS STRING) AS hgnc_id, 'SYM' || p_size AS symbol FROM {part} WHERE p_partkey % 4 = 0",
    "adeft": """SELECT p_brand AS shortform, CASE p_partkey % 6 WHEN 0 THEN 'ungrounded' WHEN 1 THEN 'EFO:EFO:' || p_size WHEN 2 THEN 'HP:' || p_size WHEN 3 THEN 'DOID:DOID:' || p_size
        WHEN 4 THEN 'HGNC:' || p_size ELSE 'NCIT:C' || p_size END AS grounding, p_name AS name FROM {part}""",
    "ontology": """SELECT 'X:' || p_partkey AS id, p_name AS name, CASE p_partkey % 4 WHEN 0 THEN p_type || ' (formerly old)' WHEN 1 THEN 'Ambiguous ' || p_type WHEN 2 THEN p_brand || '|' || p_brand ELSE '' END AS synonyms,
        CASE p_partkey % 5 WHEN 0 THEN 'MESH:D' || p_partkey WHEN 1 THEN 'DOID:' || p_size WHEN 2 THEN 'MSH:C' || p_partkey WHEN 3 THEN 'MESH:D' || p_partkey || '|DOID:DOID:' || p_size ELSE '' END AS xrefs FROM {part}""",
    "mesh_names": "SELECT 'D' || p_partkey AS mesh_id, 'mesh ' || p_brand AS mesh_name FROM {part} WHERE p_partkey % 10 < 8",
    "reverse": "SELECT 'HP' AS db, 'X:' || p_partkey AS id, 'D' || (p_partkey + 5) AS mesh_id, 'auto ' || p_brand AS mesh_name FROM {part} WHERE p_partkey % 17 = 0",
    "doid": "SELECT DISTINCT 'DOID:' || p_size AS doid, CASE WHEN p_size % 3 > 0 THEN 'disease ' || p_size END AS doid_name, CASE WHEN p_size % 5 = 0 THEN 'DOID:' || (p_size + 1) END AS primary FROM {part}",
    "mappable": """SELECT lower(p_name) || ' ' || p_partkey AS norm_text, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || p_partkey ELSE upper(p_name) || ' ' || p_partkey END AS text, 'MESH' AS db, 'D' || p_partkey AS id, 'm ' || p_size AS entry_name, 'name' AS status, 'mesh' AS source FROM {part}
        UNION ALL SELECT lower(p_name) || ' ' || p_partkey, p_name || ' ' || p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'HGNC' WHEN 1 THEN 'CHEBI' WHEN 2 THEN 'GO' WHEN 3 THEN 'HP' ELSE 'FPLX' END, 'T' || p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'M ' || p_size ELSE 't ' || p_size END, 'synonym', 'x' FROM {part} WHERE p_partkey % 4 > 0
        UNION ALL SELECT lower(p_name) || ' ' || p_partkey, p_name || ' ' || p_partkey, 'EFO', 'E' || (p_partkey % 30), 'e', 'synonym', 'x' FROM {part} WHERE p_partkey % 3 = 0
        UNION ALL SELECT lower(p_name) || ' ' || p_partkey, p_name || ' ' || p_partkey, 'MESH', 'DX' || p_partkey, 'twice', 'synonym', 'mesh' FROM {part} WHERE p_partkey % 11 = 0
        UNION ALL SELECT 'cell movement', 'cell movement', 'MESH', 'D002465', 'Cell Movement', 'name', 'mesh' FROM {region} WHERE r_regionkey = 0
        UNION ALL SELECT 'cell motility', 'cell motility', 'GO', 'GO:0048870', 'cell motility', 'name', 'go' FROM {region} WHERE r_regionkey = 0""",
    "classes": "SELECT 'D' || p_partkey AS source_id, CASE WHEN p_partkey % 2 = 0 THEN 'protein' ELSE 'chemical' END AS class FROM {part} WHERE p_partkey % 7 > 0",
    "pairs": "SELECT 'D' || (l_partkey % 90) AS source_id, 's' || (l_partkey % 30) AS source_name, 'GO' AS db, 'G' || (l_suppkey % 70) AS id, 'S' || (l_suppkey % 30) AS name FROM {lineitem} WHERE l_orderkey % 50 = 0",
    "positives": "SELECT DISTINCT 'D' || (s_suppkey % 90) AS source_id, 'HP' AS db, 'H' || s_suppkey AS id FROM {supplier} WHERE s_suppkey % 9 = 0",
    "negatives": "SELECT DISTINCT 'D' || (l_partkey % 90) AS source_id, 'GO' AS db, 'G' || (l_suppkey % 70) AS id FROM {lineitem} WHERE l_orderkey % 100 = 0",
    "ambiguous": """SELECT 'w' || (p_partkey - p_partkey % 4) AS text, CASE p_partkey % 6 WHEN 0 THEN 'CHEBI' WHEN 1 THEN 'HGNC' WHEN 2 THEN 'UP' WHEN 3 THEN 'MESH' ELSE 'GO' END AS db, CAST(p_size % 9 AS STRING) AS id,
        CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE substr(p_brand, 7) || p_name END AS entry_name, CASE p_partkey % 10 WHEN 0 THEN 'name' WHEN 1 THEN 'curated' WHEN 2 THEN 'former_name' ELSE 'synonym' END AS status,
        CASE WHEN p_partkey % 29 = 0 THEN 'adeft' ELSE 'x' END AS source, CASE p_partkey % 3 WHEN 0 THEN '9606' WHEN 1 THEN '10090' END AS organism FROM {part}""",
    "mesh_proteins": "SELECT DISTINCT CAST(p_size % 9 AS STRING) AS id FROM {part} WHERE p_size % 9 < 3",
    "uses": "SELECT 'w' || (o_orderkey % 300 - o_orderkey % 4) AS text, count(*) AS n FROM {orders} GROUP BY 1",
    "priority_terms": """SELECT lower(n_name) AS norm_text, n_name AS text, v.db, CAST(n_nationkey AS STRING) AS id, n_name AS entry_name, 'synonym' AS status, 'x' AS source
        FROM {nation} CROSS JOIN (SELECT 'EFO' AS db UNION ALL SELECT 'GO' UNION ALL SELECT 'UP' UNION ALL SELECT 'FPLX' UNION ALL SELECT 'ZZZ' UNION ALL SELECT 'HGNC') v""",
    "groundings": """SELECT o_orderkey AS k, 'A:' || (o_custkey % 7) AS gold, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'A:' || (o_orderkey % 5) || '|A:' || (o_custkey % 11) END AS found FROM {orders}""",
    "edges": "SELECT 'A:' || a AS child, 'A:' || (a + 1) AS parent FROM (SELECT DISTINCT n_regionkey AS a FROM {nation} WHERE n_regionkey < 4) t",
    "entities": """SELECT c_nationkey AS doc, c_custkey AS ord, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'E:' || (c_custkey % 9) END AS a, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'E:' || (c_custkey % 6) END AS b FROM {customer}""",
    "asked": "SELECT DISTINCT n.n_name AS raw, r.r_name || ' ' || lower(n.n_name) || ' ' || CASE WHEN n.n_nationkey % 3 = 0 THEN 'asia africa' ELSE 'x' END AS context FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey",
    "models": """SELECT n_name AS surface, CASE WHEN n_nationkey % 2 = 0 THEN 'adeft' ELSE 'own' END AS kind, 'GO:' || n_nationkey AS label, CAST(NULL AS STRING) AS feature, CAST(0.5 AS DOUBLE) AS weight FROM {nation} WHERE n_nationkey % 5 < 4
        UNION ALL SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'adeft' ELSE 'own' END, 'UP:' || n_nationkey, CAST(NULL AS STRING), CAST(0.25 AS DOUBLE) FROM {nation} WHERE n_nationkey % 5 < 4
        UNION ALL SELECT n_name, 'adeft', 'ungrounded', CAST(NULL AS STRING), CAST(0.125 AS DOUBLE) FROM {nation} WHERE n_nationkey % 5 < 4 AND n_nationkey % 4 = 0
        UNION ALL SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'adeft' ELSE 'own' END, 'GO:' || n_nationkey, lower(r_name), CAST(1.5 AS DOUBLE) FROM {nation} CROSS JOIN {region} WHERE n_nationkey % 5 < 4 AND r_regionkey < 3""",
}

INPUTS["ontology_efo"] = INPUTS["ontology"].replace("'X:' || p_partkey AS id", "CASE WHEN p_partkey % 9 = 0 THEN 'BFO:' ELSE 'X:' END || p_partkey AS id")


def given(spark, sf_dir: str, name: str) -> DataFrame:
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("part", "nation", "region", "supplier", "lineitem", "orders", "customer")}
    return spark.sql(INPUTS[name].format(**tables))


def _listed(df: DataFrame, *columns: str) -> DataFrame:
    """Texts with | as arrays of what is not empty."""
    for c in columns:
        df = df.withColumn(c, F.filter(F.split(c, r"\|"), lambda x: x != ""))
    return df


def _terms(spark, sf_dir, name: str) -> DataFrame:
    rows = given(spark, sf_dir, name)
    missing = [c for c in lexicon.COLUMNS if c not in rows.columns]
    rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in missing if c != "norm_text"])
    return rows.withColumn("norm_text", F.col("norm_text") if "norm_text" in rows.columns else F.lower("text")).select(*lexicon.COLUMNS)


def hgnc_terms(spark, sf_dir):
    return etl.hgnc_terms(given(spark, sf_dir, "hgnc"))


def chebi_terms(spark, sf_dir):
    names = etl.chebi_synonyms(given(spark, sf_dir, "chebi_names"), given(spark, sf_dir, "chebi_primary"))
    return etl.chebi_terms(_listed(given(spark, sf_dir, "chebi"), "synonyms"), names)


def mesh_terms(spark, sf_dir):
    return etl.mesh_terms(given(spark, sf_dir, "mesh"), given(spark, sf_dir, "forward"))


def go_terms(spark, sf_dir):
    return etl.go_terms(_listed(given(spark, sf_dir, "go"), "synonyms"))


def famplex_terms(spark, sf_dir):
    fields = given(spark, sf_dir, "famplex").select("text", F.split("pairs", r"\|").alias("fields"))
    rows = lexicon.grounding_map(fields)
    return etl.famplex_terms(rows, *[given(spark, sf_dir, n) for n in ("forward", "genes", "proteins", "labels_of")])


def uniprot_terms(spark, sf_dir):
    return etl.uniprot_terms(given(spark, sf_dir, "uniprot"), given(spark, sf_dir, "gene_of"))


def adeft_terms(spark, sf_dir):
    return etl.adeft_terms(given(spark, sf_dir, "adeft"))


def _ontology(spark, sf_dir, name, prefix):
    rows = _listed(given(spark, sf_dir, name), "synonyms", "xrefs")
    rows = rows.withColumn("xrefs", F.transform("xrefs", lambda x: F.struct(F.split(x, ":", 2)[0].alias("namespace"), F.split(x, ":", 2)[1].alias("id"))))
    return etl.obo_terms(rows, prefix, *[given(spark, sf_dir, n) for n in ("mesh_names", "forward", "reverse", "doid")])


def obo_terms(spark, sf_dir):
    return _ontology(spark, sf_dir, "ontology", "hp")


def efo_terms(spark, sf_dir):
    """An ontology that brings upper-level entries of another one, which are left out."""
    return _ontology(spark, sf_dir, "ontology_efo", "efo")


def all_terms(spark, sf_dir):
    """All eight sources, one of them twice, without duplicates."""
    sources = (hgnc_terms, chebi_terms, mesh_terms, go_terms, famplex_terms, uniprot_terms, adeft_terms, obo_terms, go_terms)
    return etl.all_terms(*[f(spark, sf_dir) for f in sources])


def mapping_candidates(spark, sf_dir):
    return lexicon_ops.mapping_candidates(_terms(spark, sf_dir, "mappable"))


def mappings_by_priority(spark, sf_dir):
    return lexicon_ops.by_priority(lexicon_ops.mapping_candidates(_terms(spark, sf_dir, "mappable")), classes=given(spark, sf_dir, "classes"))


def mappings_built(spark, sf_dir):
    return lexicon_ops.build_mappings(_terms(spark, sf_dir, "mappable"), given(spark, sf_dir, "classes"))


def mappings_one_to_one(spark, sf_dir):
    return lexicon_ops.one_to_one(given(spark, sf_dir, "pairs"))


def mappings_overridden(spark, sf_dir):
    return lexicon_ops.with_overrides(given(spark, sf_dir, "pairs").distinct(), given(spark, sf_dir, "positives"), given(spark, sf_dir, "negatives"))


def ambiguities_flagged(spark, sf_dir):
    return lexicon_ops.ambiguities(_terms(spark, sf_dir, "ambiguous"), skip_names=False, skip_curated=False).drop("terms")


def ambiguities_strict(spark, sf_dir):
    return lexicon_ops.ambiguities(_terms(spark, sf_dir, "ambiguous")).drop("terms")


def training_ambiguities(spark, sf_dir):
    found = lexicon_ops.training_ambiguities(_terms(spark, sf_dir, "ambiguous"), given(spark, sf_dir, "mesh_proteins"))
    return lexicon_ops.rank_ambiguities(found, given(spark, sf_dir, "uses")).select("text", "n_groundings", "n")


def names_of(spark, sf_dir):
    terms = derived.lexicon(spark, sf_dir)
    grounder = Grounder(spark, terms)
    out = [grounder.get_names("NATION", str(k), status=s).withColumn("id", F.lit(str(k))) for k, s in ((1, "name"), (3, None), (5, "name"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


def namespace_priority(spark, sf_dir):
    terms = _terms(spark, sf_dir, "priority_terms")
    return Grounder(spark, terms).ground(terms.select(F.col("text").alias("raw"))).select("raw", "rank", "db", "id", F.col("term.text").alias("text"))


def disambiguation_factors(spark, sf_dir):
    asked = given(spark, sf_dir, "asked").withColumn("context_key", context_key("context"))
    matches = asked.select("raw", "context_key", F.explode(F.array(*[F.lit(x) for x in ("GO", "UP", "HP")])).alias("db"), F.lit(0.5).alias("score"))
    ids = given(spark, sf_dir, "models").filter("label <> 'ungrounded'").select(F.col("surface").alias("raw"), F.split_part("label", F.lit(":"), F.lit(2)).alias("id")).distinct()
    matches = matches.join(ids, "raw", "left").withColumn("id", F.coalesce("id", F.lit("none")))
    found = disambiguation.disambiguate(matches, asked.select("context_key", "context"), given(spark, sf_dir, "models"))
    return found.select("raw", "db", "id", F.round("score", 9).alias("score"), F.col("disambiguation.type").alias("type"), F.col("disambiguation.match").alias("match"))


def correctness(spark, sf_dir):
    rows = given(spark, sf_dir, "groundings").select("k", F.array("gold").alias("gold"), F.filter(F.split("found", r"\|"), lambda x: x != "").alias("groundings"))
    edges = evaluation.closure(given(spark, sf_dir, "edges"))
    return evaluation.correctness(rows, members=edges, ancestors=edges).drop("gold", "groundings")


def namespace_breakdown(spark, sf_dir):
    rows = given(spark, sf_dir, "groundings").select(F.array("gold").alias("gold"), F.filter(F.split("found", r"\|"), lambda x: x != "").alias("groundings"))
    rows = evaluation.correctness(rows)
    out = evaluation.namespace_breakdown(rows, "A:3")
    return out.select("tp", "fp", "positives", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def crosstab_totals(spark, sf_dir):
    return evaluation.mapping_table(derived.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], total=True)


def agreement_classes(spark, sf_dir):
    rows = given(spark, sf_dir, "entities")
    side = lambda c: rows.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("v")))), lambda x: x["v"]).alias("entities"))
    both = evaluation.positional(side("a"), side("b"), "doc")
    return both.groupBy(evaluation.agreement(F.col("a"), F.col("b")).alias("agreement")).agg(F.count("*").alias("n"))


def value_counts(spark, sf_dir):
    return evaluation.value_counts(derived.table(spark, sf_dir, "customer"), "c_mktsegment")


def group_synonyms(spark, sf_dir):
    rows = derived.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 40).alias("article"), F.col("l_returnflag").alias("text"), F.array(F.col("l_linenumber").cast("string"), "l_linestatus").alias("synonyms"))
    return evaluation.group_synonyms(rows).select("article", "text", F.array_join("synonyms", ",").alias("synonyms"))


def metabolite_names(spark, sf_dir):
    rows = derived.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("acid(abc)"))).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit("/"), "p_type")).otherwise(F.lit("stereamide")).alias("raw"))
    return rows.select("k", vocab.metabolite_name("raw").alias("name"))


def annotation_lines(spark, sf_dir):
    """Every annotation of every document with the real tokenizer, as standoff lines."""
    found = annotation.annotated(derived.documents(spark, sf_dir), Grounder(spark, derived.word_lexicon(spark, sf_dir)), "text", "doc_id", columns=("raw", "curie"))
    return found.select("id", annotation.standoff("annotations").alias("brat"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in ("queries", "given")}
