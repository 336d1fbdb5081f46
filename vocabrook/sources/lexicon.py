"""Readers and writers of lexicons, vocabularies and corpora. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, vocab

COLUMNS = ("norm_text", "text", "db", "id", "entry_name", "status", "source", "organism", "source_db", "source_id")
TERMS = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
BUCKETS = 64


def valid(terms: DataFrame) -> DataFrame:
    """Entries that have a text and a norm_text that is not blank."""
    return terms.filter((F.length("text") > 0) & (F.length(F.trim("norm_text")) > 0))


def rejected(terms: DataFrame) -> DataFrame:
    return terms.filter(~F.coalesce((F.length("text") > 0) & (F.length(F.trim("norm_text")) > 0), F.lit(False)))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """A (gzipped) TSV with header; empty fields are null, 'NA' is a value."""
    options = {"header": True, "sep": "\t", "quote": '"', "escape": '"', "multiLine": True, "nullValue": "", "emptyValue": ""}
    raw = spark.read.schema(TERMS).options(**options).csv(path)
    return raw.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in COLUMNS])


def write_terms(terms: DataFrame, path: str, files: int | None = None) -> None:
    """The counterpart of read_terms(): exact for nulls, quotes, tabs and outer spaces."""
    out = terms.select(*COLUMNS)
    out = out.coalesce(files) if files else out
    out.write.mode("overwrite").options(sep="\t", header=True, quote='"', escape='"', compression="gzip", nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def build_table(terms: DataFrame, name: str, buckets: int = BUCKETS) -> None:
    """A table bucketed and sorted by norm_text: look-ups and later joins on it don't shuffle it. Fails if it exists."""
    terms.select(*COLUMNS).write.bucketBy(buckets, "norm_text").sortBy("norm_text").format("parquet").mode("error").saveAsTable(name)


class TermTable:
    """A keyed view of a lexicon; every look-up stays a filter or aggregation that can be pushed down."""

    def __init__(self, terms: DataFrame):
        self.terms = terms

    @property
    def columns(self) -> list[str]:
        return self.terms.columns

    def get(self, key: str) -> DataFrame:
        return self.terms.filter(F.col("norm_text") == key)

    def __getitem__(self, key: str) -> DataFrame:
        found = self.get(key)
        if found.isEmpty():
            raise KeyError(key)
        return found

    def __len__(self) -> int:
        return self.terms.agg(F.countDistinct("norm_text")).first()[0]

    def keys(self) -> DataFrame:
        return self.terms.select("norm_text").distinct()

    def values(self) -> DataFrame:
        """norm_text, terms array<struct>, one row a key."""
        return self.terms.groupBy("norm_text").agg(F.sort_array(F.collect_list(F.struct(*COLUMNS))).alias("terms"))


#: Where load() looks for a lexicon if none is named.
DEFAULT = "spark.vocabrook.terms"


def load(spark: SparkSession, terms=None) -> DataFrame:
    """A lexicon from a DataFrame, a path (.tsv, .tsv.gz, .parquet), a database (jdbc:.. or a .db file), a table name, rows, or a
    dict of rows by key; without one, from what the session's setting spark.vocabrook.terms names.
    """
    if terms is None:
        terms = spark.conf.get(DEFAULT, None)
        if not terms:
            raise ValueError(f"no terms given, and {DEFAULT} is not set")
    if isinstance(terms, DataFrame):
        return terms.select(*COLUMNS)
    if isinstance(terms, Path):
        terms = str(terms)
    if isinstance(terms, str):
        if terms.endswith(".db") and not terms.startswith("jdbc:"):
            terms = f"jdbc:sqlite:{terms}"
        if terms.startswith("jdbc:"):
            return spark.read.format("jdbc").options(url=terms, dbtable="terms").load().select(*COLUMNS)
        if terms.endswith((".tsv", ".tsv.gz", ".csv", ".gz")):
            return read_terms(spark, terms)
        if terms.endswith(".parquet") or "/" in terms:
            return spark.read.parquet(terms).select(*COLUMNS)
        return spark.table(terms).select(*COLUMNS)
    if isinstance(terms, dict):
        terms = [t for ts in terms.values() for t in ts]
    if hasattr(terms, "__iter__"):
        rows = [tuple(t.get(c) for c in COLUMNS) if isinstance(t, dict) else tuple(t) for t in terms]
        return spark.createDataFrame([tuple(None if x is None else str(x) for x in r) for r in rows], TERMS)
    raise TypeError(f"terms can't be of type {type(terms).__name__}")


def name_synonym_terms(rows: DataFrame, db: str, source: str | None = None, organism: str | None = None) -> DataFrame:
    """id, name, synonyms array<string> -> entries of a vocabulary of one's own."""
    c = F.col
    words = F.filter(F.coalesce("synonyms", F.array().cast("array<string>")), lambda x: x != c("name"))
    texts = F.concat(F.array(F.struct(c("name").alias("text"), F.lit("name").alias("status"))), F.transform(F.array_distinct(words), lambda x: F.struct(x.alias("text"), F.lit("synonym").alias("status"))))
    null = F.lit(None).cast("string")
    out = rows.select("id", "name", F.explode(texts).alias("t")).filter("t.text <> ''")
    out = out.select(
        "t.text", F.lit(db).alias("db"), "id", c("name").alias("entry_name"), "t.status", F.lit(source or db.lower()).alias("source"), F.lit(organism).cast("string").alias("organism"),
        null.alias("source_db"), null.alias("source_id"),
    )
    return valid(out.withColumn("norm_text", text.normalize("text"))).select(*COLUMNS)


def terms_to_json(terms: DataFrame) -> DataFrame:
    """One JSON object an entry; fields that are null are left out."""
    return terms.select(F.to_json(F.struct(*COLUMNS)).alias("json"))


# ---- other vocabularies ------------------------------------------------------------------------


def read_delimited(spark: SparkSession, path: str, columns: list[str], header: bool = True, delimiter: str = "\t", quote: str | None = '"') -> DataFrame:
    """Generic delimited text, all strings; quote None switches quoting off."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).options(header=header, sep=delimiter, quote=quote or "", multiLine=quote is not None, enforceSchema=True).csv(path)


#: The columns of downloaded files, in their order, and what the operators call them.
HGNC_COLUMNS = ("hgnc_id", "symbol", "name", "status", "aliases", "previous", "alias_names")
MESH_COLUMNS = ("id", "name", "synonyms")
UNIPROT_COLUMNS = ("entry", "primary", "synonyms", "organism", "names")
CHEBI_NAME_COLUMNS = ("row_id", "compound_id", "type", "source", "name", "adapted", "language")


def read_hgnc(spark: SparkSession, path: str) -> DataFrame:
    """The gene table as etl.hgnc_terms() takes it; quotation marks are data."""
    return read_delimited(spark, path, list(HGNC_COLUMNS), quote=None)


def read_mesh(spark: SparkSession, path: str) -> DataFrame:
    """Descriptor or supplementary labels: id, name, synonyms ('|'); no header."""
    return read_delimited(spark, path, list(MESH_COLUMNS), header=False)


def read_uniprot(spark: SparkSession, path: str, organisms: list[str] | None = None) -> DataFrame:
    """Protein entries, of the organisms only if some are named."""
    rows = read_delimited(spark, path, list(UNIPROT_COLUMNS), quote=None)
    return rows.filter(F.col("organism").isin(*organisms)) if organisms else rows


def read_chebi_names(spark: SparkSession, path: str) -> DataFrame:
    """Compound names as etl.chebi_synonyms() takes them."""
    return read_delimited(spark, path, list(CHEBI_NAME_COLUMNS)).select("compound_id", "name")


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    """text, fields: comma-separated rows of any length, as grounding_map() takes them; quoted fields may hold commas."""
    items = F.transform(F.regexp_extract_all("value", F.lit('(?:^|,)((?:"(?:[^"]|"")*")|[^,]*)'), F.lit(1)), lambda x: F.when(x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return spark.read.text(path).filter("value <> ''").select(items.alias("i")).select(F.col("i")[0].alias("text"), F.slice("i", F.lit(2), F.size("i")).alias("fields"))


def read_bioid(spark: SparkSession, path: str) -> DataFrame:
    """Gold annotations from a CSV with header: text, obj (array of curies), entity_type, don_article; unknown types are left out."""
    rows = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path).select("text", "don_article", vocab.normal_ids("obj").alias("obj"))
    return rows.withColumn("entity_type", vocab.entity_type("obj")).filter("entity_type <> 'unknown'").select("text", "obj", "entity_type", "don_article")


def read_bioid_spans(spark: SparkSession, path: str) -> DataFrame:
    """As read_bioid(), with the figure and the span in its caption: doc, figure, text, start, end, obj, entity_type."""
    rows = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path).withColumn("obj", vocab.normal_ids("obj")).withColumn("entity_type", vocab.entity_type("obj"))
    span = F.col("first left").cast("int").alias("start"), F.col("last right").cast("int").alias("end")
    return rows.filter("entity_type <> 'unknown'").select(F.col("don_article").alias("doc"), "figure", "text", *span, "obj", "entity_type")


def read_full_text(spark: SparkSession, path: str) -> DataFrame:
    """article (the file's name), text: the passages of each XML file in a folder, a line each."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.xml$", 1).alias("article"), "value")
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))
    unescaped = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    passages = F.regexp_extract_all("value", F.lit(r"(?s)<text(?:\s[^>]*)?>(.*?)</text>"), F.lit(1))
    return raw.select("article", F.concat(F.array_join(F.transform(passages, lambda x: unescaped(plain(x))), "\n"), F.lit("\n")).alias("text"))


def first_fields(spark: SparkSession, path: str) -> DataFrame:
    """text: the distinct first fields of a CSV with header."""
    return spark.read.options(header=True, quote='"', escape='"').csv(path).toDF(*["text", *[f"_{k}" for k in range(1, len(spark.read.option("header", True).csv(path).columns))]]).select("text").filter("text <> ''").distinct()


def read_json_array(spark: SparkSession, path: str, schema) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


OBO_ENTRY = "id string, name string, synonyms array<string>, xrefs array<struct<namespace:string,id:string>>"


def read_obo(spark: SparkSession, path: str, obsolete: bool = False) -> DataFrame:
    """Term stanzas of an OBO text (any line ends): id, name, synonyms, xrefs; obsolete ones only if asked for."""
    stanza = spark.read.option("lineSep", "[Term]").text(path).withColumn("value", F.regexp_replace("value", "\r\n?", "\n"))
    # what follows the last [Term] of a file may hold other stanzas
    stanza = stanza.withColumn("value", F.split("value", r"\n\[", 2)[0]).filter(F.col("value").rlike(r"(?m)^id: "))
    stanza = stanza.filter(~F.col("value").rlike(r"(?m)^(format-version|ontology): "))
    if not obsolete:
        stanza = stanza.filter(~F.col("value").rlike(r"(?m)^is_obsolete: true"))
    line = lambda tag: F.regexp_extract("value", rf"(?m)^{tag}: (.*?)\s*$", 1)
    xref = F.transform(F.regexp_extract_all("value", F.lit(r"(?m)^xref: (\S+:\S+)"), F.lit(1)), lambda x: F.struct(F.split(x, ":", 2)[0].alias("namespace"), F.split(x, ":", 2)[1].alias("id")))
    return stanza.select(line("id").alias("id"), line("name").alias("name"), F.regexp_extract_all("value", F.lit(r'(?m)^synonym: "((?:[^"\\]|\\.)*)"'), F.lit(1)).alias("synonyms"), xref.alias("xrefs"))


def read_obo_graph(spark: SparkSession, path: str) -> DataFrame:
    """OBO graphs in JSON: graphs[].nodes[] as id, name, synonyms, xrefs."""
    schema = "graphs array<struct<nodes:array<struct<id:string,lbl:string,meta:struct<synonyms:array<struct<val:string>>,xrefs:array<struct<val:string>>>>>>>"
    node = read_json_array(spark, path, schema).select(F.explode("graphs").alias("g")).select(F.explode("g.nodes").alias("n"))
    none = F.array().cast("array<string>")
    xrefs = F.transform(F.coalesce("n.meta.xrefs.val", none), lambda x: F.struct(F.split(x, ":", 2)[0].alias("namespace"), F.split(x, ":", 2)[1].alias("id")))
    return node.filter("n.lbl is not null").select("n.id", F.col("n.lbl").alias("name"), F.coalesce("n.meta.synonyms.val", none).alias("synonyms"), xrefs.alias("xrefs"))


def mapping_table(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mesh_db, mesh_id, mesh_name, db, id, name, ord -> forward (mesh_id) and reverse (db, id) maps; the last row wins."""
    last = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ord")))
    forward = rows.withColumn("_n", last("mesh_id")).filter("_n = 1").select("mesh_id", "db", "id", "name")
    reverse = rows.withColumn("_n", last("db", "id")).filter("_n = 1").select("db", "id", "mesh_id", "mesh_name")
    return forward, reverse


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A stop list: one word a line, trimmed, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''").distinct()


def read_models(spark: SparkSession, path: str, cutoff: float = 0.7) -> DataFrame:
    """surface, stats of the disambiguation models whose mean F1 is above cutoff."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<stats:struct<f1:struct<mean:double>>>>")).alias("surface", "model"))
    return raw.filter(F.col("model.stats.f1.mean") > cutoff).select("surface", F.col("model.stats.f1.mean").alias("f1"))


_MODEL = (
    "logit:struct<classes_:array<string>,intercept_:array<double>,coef_:array<array<double>>>,"
    "tfidf:struct<vocabulary_:map<string,int>,idf_:array<double>>,stats:struct<f1:struct<mean:double>>"
)


def read_model_rows(spark: SparkSession, path: str, cutoff: float = 0.7, kind: str = "own") -> DataFrame:
    """The models of such a file whose mean F1 is above cutoff, as rows that disambiguation takes: surface, kind, label, feature, weight, idf, f1.

    Of two labels, the file has one vector, which tells the second from the first: the first one's weights are 0.
    """
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,struct<{_MODEL}>>")).alias("surface", "m"))
    raw = raw.filter(F.col("m.stats.f1.mean") > cutoff)
    none = F.struct(F.lit(None).cast("string").alias("feature"), F.lit(None).cast("int").alias("at"))
    words = F.transform(F.map_entries("m.tfidf.vocabulary_"), lambda e: F.struct(e["key"].alias("feature"), e["value"].alias("at")))
    rows = raw.select("surface", "m", F.explode(F.concat(F.array(none), words)).alias("x"))
    rows = rows.select("surface", F.col("m.stats.f1.mean").alias("f1"), "m.logit", F.get("m.tfidf.idf_", F.col("x.at")).alias("idf"), "x", F.posexplode("m.logit.classes_").alias("side", "label"))
    vector = F.col("side") - F.when(F.size("logit.coef_") == 1, 1).otherwise(0)
    weight = F.when(F.col("x.feature").isNull(), F.get("logit.intercept_", vector)).otherwise(F.get(F.get("logit.coef_", vector), F.col("x.at")))
    return rows.select("surface", F.lit(kind).alias("kind"), "label", F.col("x.feature").alias("feature"), F.coalesce(weight, F.lit(0.0)).alias("weight"), "idf", "f1")


def read_bioc(spark: SparkSession, path: str) -> DataFrame:
    """BioC XML annotations: doc_id (up to the first space), passage offset, text, type, start, end."""
    schema = (
        "_id string, id string, passage array<struct<offset:int,text:string,annotation:array<struct<_id:string,infon:array<struct<_key:string,_VALUE:string>>,location:array<struct<_offset:int,_length:int>>,text:string>>>>"
    )
    docs = spark.read.format("xml").option("rowTag", "document").schema(schema).load(path)
    rows = docs.select(F.split(F.coalesce("id", "_id"), " ", 2)[0].alias("doc_id"), F.explode("passage").alias("p")).select("doc_id", "p.offset", F.explode("p.annotation").alias("a"))
    kind = F.try_element_at(F.filter("a.infon", lambda i: i["_key"] == "type"), F.lit(1))["_VALUE"]
    at = F.try_element_at(F.col("a.location"), F.lit(1))
    return rows.select("doc_id", F.col("offset").alias("passage_offset"), F.col("a.text").alias("text"), kind.alias("type"), at["_offset"].alias("start"), (at["_offset"] + at["_length"]).alias("end"))


def medmentions(docs: DataFrame) -> DataFrame:
    """Documents with entities array -> one row an entity; semantic types split at commas."""
    return docs.select("id", F.explode("entities").alias("e")).select("id", "e.start_index", "e.end_index", "e.text_segment", F.split("e.semantic_type_id", ",").alias("semantic_types"), "e.entity_id")


def grounding_map(rows: DataFrame, values: str = "fields") -> DataFrame:
    """text, alternating namespace and id fields -> text, map<namespace, id>; blank pairs are left out."""
    n = F.size(values)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest((n / 2).cast("int") - 1, F.lit(0))), lambda k: F.struct(F.get(values, 2 * k).alias("k"), F.get(values, 2 * k + 1).alias("v")))
    return rows.select("text", F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["k"] != "", F.lit(False)))).alias("groundings"))


def before_first_null(rows: DataFrame, column: str, ord_: str = "ord") -> DataFrame:
    """The rows before the first one with a null in column: a minimum and a filter, not a window over everything."""
    stop = rows.filter(F.col(column).isNull()).agg(F.min(ord_)).scalar()
    return rows.filter(F.coalesce(F.col(ord_) < stop, F.lit(True)))


def curated_groundings(rows: DataFrame, pubchem: DataFrame | None = None, most: int = 3) -> DataFrame:
    """Rows of a curation table (ord, Text, EntityType, Sentence, Grounding, DB_Ns1, DB_Id1, ..) -> ord, text, entity_type, correct, context, db_refs.

    The table ends at the first row without a verdict. A doubled GO prefix is cut. pubchem(id, chebi_id): a compound's ChEBI
    id joins the others, or takes the place of one.
    """
    rows = before_first_null(rows, "Grounding")
    pair = lambda k: F.struct(F.col(f"DB_Ns{k}").alias("key"), F.when(F.col(f"DB_Id{k}").startswith("GO:GO"), F.substr(f"DB_Id{k}", F.lit(4))).otherwise(F.col(f"DB_Id{k}")).alias("value"))
    pairs = F.filter(F.array(*[pair(k) for k in range(1, most + 1)]), lambda p: p["key"].isNotNull())
    # of one namespace twice, the last one counts
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.lit(most)), lambda q: q["key"] == p["key"]))
    out = rows.select("ord", F.col("Text").alias("text"), F.col("EntityType").alias("entity_type"), (F.col("Grounding").cast("int") != 0).alias("correct"), F.col("Sentence").alias("context"), F.map_from_entries(last).alias("db_refs"))
    if pubchem is None:
        return out
    known = pubchem.groupBy(F.col("id").alias("pubchem")).agg(F.min("chebi_id").alias("chebi"))
    out = out.withColumn("pubchem", F.try_element_at("db_refs", F.lit("PUBCHEM"))).join(known, "pubchem", "left")
    more = F.map_concat(F.map_filter("db_refs", lambda k, _: k != "CHEBI"), F.create_map(F.lit("CHEBI"), F.col("chebi")))
    return out.withColumn("db_refs", F.when(F.col("chebi").isNotNull(), more).otherwise(F.col("db_refs"))).drop("pubchem", "chebi")


def read_curated(spark: SparkSession, path: str, pubchem: DataFrame | None = None) -> DataFrame:
    """curated_groundings() of a CSV with header, in the order of the file."""
    rows = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path).withColumn("ord", F.monotonically_increasing_id())
    return curated_groundings(rows, pubchem)


def read_class_blocks(spark: SparkSession, path: str, marker: str = "# Class: obo:", pattern: str = "MESH:[CD][0-9]+") -> DataFrame:
    """id, other: of an ontology file that is a block a class, the id that a line of the block names alone (the last such line's).

    The marker is the separator of records, so that blocks are read apart; the head of the file is no block.
    """
    blocks = spark.read.option("lineSep", marker).text(path).filter(F.col("value").rlike("^[A-Za-z]+_[0-9]"))
    lines = F.transform(F.split("value", "\n"), lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), F.lit(0))))
    name = F.regexp_replace(F.regexp_extract("value", "^([A-Za-z]+_[0-9]+)", 1), "_", ":")
    return blocks.select(name.alias("id"), lines.alias("lines")).filter(F.exists("lines", lambda x: F.size(x) == 1)).select("id", F.element_at(F.filter("lines", lambda x: F.size(x) == 1), -1)[0].alias("other"))


def oriented_mappings(rows: DataFrame, prefix: str = "mesh") -> DataFrame:
    """Exact matches of a curated mapping table, turned so that prefix stands on the left; namespaces in upper case."""
    exact = rows.filter(F.col("relation") == "skos:exactMatch")
    side = lambda a, b: exact.filter(F.lower(F.col(f"{a}_prefix")) == prefix).select(F.col(f"{a}_id").alias("mesh_id"), F.upper(f"{b}_prefix").alias("db"), F.col(f"{b}_id").alias("id"))
    return side("source", "target").unionByName(side("target", "source"))
