"""Vocabulary sources to lexicon entries: every source is a projection with one explode, and all are united and deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..sources.lexicon import COLUMNS
from .lexicon_ops import filter_out_duplicates


def _null() -> Column:
    return F.lit(None).cast("string")


def entry(value, db, id_, name, status, source, organism=None, source_db=None, source_id=None) -> Column:
    """One lexicon entry as a struct; norm_text comes with to_terms()."""
    lit = lambda x: _null() if x is None else F.lit(x) if isinstance(x, str) else x
    parts = {"text": value, "db": db, "id": id_, "entry_name": name, "status": status, "source": source, "organism": organism, "source_db": source_db, "source_id": source_id}
    return F.struct(*[lit(v).alias(k) for k, v in parts.items()])


def to_terms(rows: DataFrame, entries: Column) -> DataFrame:
    """Rows with an array of entries -> lexicon; blank texts are left out."""
    t = rows.select(F.explode(entries).alias("e")).select("e.*").filter(F.length(F.trim("text")) > 0)
    return t.withColumn("norm_text", text.normalize("text")).select(*COLUMNS)


def _list(value, sep: str = ", ") -> Column:
    return F.filter(F.split(F.coalesce(value, F.lit("")), sep), lambda x: x != "")


def hgnc_terms(rows: DataFrame) -> DataFrame:
    """hgnc_id, symbol, name, status, aliases, previous, alias_names -> human gene entries.

    Withdrawn symbols become former names of the gene that they refer to; all other rows are genes.
    """
    c = F.col
    rows = rows.withColumn("gid", F.regexp_replace("hgnc_id", "^HGNC:", ""))
    withdrawn = F.coalesce(c("status") == "Symbol Withdrawn", F.lit(False))
    # alias names carry the source 'synonym': a fixed value of the lexicon's format
    one = lambda x, status, source="hgnc": entry(x, "HGNC", c("gid"), c("symbol"), status, source, "9606")
    all_of = lambda values, status, source="hgnc": F.transform(values, lambda x: one(x, status, source))
    own = F.concat(
        all_of(F.array_distinct(F.array_compact(F.array("symbol", "name"))), "name"),
        all_of(_list(c("aliases")), "synonym"),
        all_of(_list(c("previous")), "former_name"),
        all_of(F.filter(vocab.alias_names(F.coalesce("alias_names", F.lit(""))), lambda x: x != ""), "synonym", "synonym"),
    )
    live = to_terms(rows.filter(~withdrawn), own)
    names = rows.select(c("gid").alias("to"), c("symbol").alias("to_symbol")).filter("to is not null")
    gone = rows.filter(withdrawn).withColumn("to", vocab.withdrawn_to("name")).join(names, "to")
    redirected = F.array(entry(c("symbol"), "HGNC", c("to"), c("to_symbol"), "former_name", "hgnc", "9606"))
    return live.unionByName(to_terms(gone, redirected))


def chebi_synonyms(names: DataFrame, primary: DataFrame | None = None) -> DataFrame:
    """names(compound_id, name) of the synonym file -> id ('CHEBI:..' of the primary compound), name.

    primary(compound_id, primary_id): compounds that were merged into others.
    """
    number = F.col("compound_id").cast("long").cast("string")
    rows = names.select(number.alias("compound_id"), "name").filter("compound_id is not null and name is not null")
    if primary is None:
        return rows.select(F.concat(F.lit("CHEBI:"), "compound_id").alias("id"), "name")
    primary = primary.select(number.alias("compound_id"), F.col("primary_id").cast("long").cast("string").alias("to"))
    return rows.join(primary, "compound_id", "left").select(F.concat(F.lit("CHEBI:"), F.coalesce("to", "compound_id")).alias("id"), "name")


def chebi_terms(obo: DataFrame, names: DataFrame) -> DataFrame:
    """obo(id, name, and synonyms if it has them) preferred names and an ontology's own synonyms, names(id, name) those of the name
    file; acronyms of amino-acid sequences among the latter are no synonyms. A synonym that both have is there twice."""
    c = F.col
    own = obo.select("id", "name", F.array_compact(F.transform(F.array_distinct("synonyms"), lambda x: vocab.clean_synonym(x))).alias("synonyms")) if "synonyms" in obo.columns else None
    preferred = to_terms(obo, F.array(entry(c("name"), "CHEBI", c("id"), c("name"), "name", "chebi")))
    others = names.distinct().join(obo.select("id", c("name").alias("standard")), "id").filter("standard is not null")
    others = others.filter(~(vocab.is_aa_sequence("standard") & c("name").rlike("^[A-Z-]+$")))
    if own is not None:
        preferred = preferred.unionByName(to_terms(own, F.transform("synonyms", lambda x: entry(x, "CHEBI", c("id"), c("name"), "synonym", "chebi"))))
    return preferred.unionByName(to_terms(others, F.array(entry(c("name"), "CHEBI", c("id"), c("standard"), "synonym", "chebi"))))


#: Mapped entries of these namespaces stay MeSH entries.
MESH_STAYS = ("EFO", "HP", "DOID")


def mesh_terms(rows: DataFrame, forward: DataFrame | None = None) -> DataFrame:
    """id, name, synonyms ('|') and the mappings (mesh_id, db, id, name): mapped entries are synonyms of their target."""
    c = F.col
    rows = rows.select(c("id").alias("mesh_id"), c("name").alias("mesh_name"), "synonyms")
    mapped = rows.join(forward.filter(~F.col("db").isin(*MESH_STAYS)), "mesh_id", "left") if forward is not None else rows.select("*", *[_null().alias(x) for x in ("db", "id", "name")])
    on = c("db").isNotNull()
    one = lambda x, status: entry(x, F.coalesce("db", F.lit("MESH")), F.coalesce("id", "mesh_id"), F.coalesce("name", "mesh_name"), status, "mesh", None, F.when(on, "MESH"), F.when(on, c("mesh_id")))
    return to_terms(mapped, F.concat(F.array(one(c("mesh_name"), F.when(on, "synonym").otherwise("name"))), F.transform(_list(c("synonyms"), r"\|"), lambda x: one(x, "synonym"))))


def go_terms(rows: DataFrame) -> DataFrame:
    """id, name, synonyms: of an activity's synonyms, those without the word 'activity' are not its names."""
    c = F.col
    synonyms = F.filter(F.array_except("synonyms", F.array("name")), lambda x: ~c("name").contains("activity") | x.contains("activity"))
    return to_terms(rows, F.concat(F.array(entry(c("name"), "GO", c("id"), c("name"), "name", "go")), F.transform(synonyms, lambda x: entry(x, "GO", c("id"), c("name"), "synonym", "go"))))


FAMPLEX_PRIORITY = ("FPLX", "HGNC", "UP", "CHEBI", "GO", "MESH")


def famplex_terms(rows: DataFrame, forward: DataFrame | None = None, genes: DataFrame | None = None, proteins: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """text, groundings map -> curated entries of the first namespace that is there.

    forward(mesh_id, db, id, name): MeSH mappings. genes(symbol, hgnc_id). proteins(entry, hgnc_id, symbol): human ones,
    hgnc_id null where there is no gene. names(db, id, name): names of chemicals, processes and descriptors. A gene whose
    symbol is not known is left out.
    """
    c, null = F.col, _null()
    spark = rows.sparkSession
    none = lambda columns: spark.createDataFrame([], ", ".join(f"{x} string" for x in columns.split()))
    forward = none("mesh_id db id name") if forward is None else forward
    genes = none("symbol hgnc_id") if genes is None else genes
    proteins = none("entry hgnc_id symbol") if proteins is None else proteins
    names = none("db id name") if names is None else names
    first = F.coalesce(*[F.when(F.map_contains_key("groundings", p), p) for p in FAMPLEX_PRIORITY])
    rows = rows.select("text", "groundings").withColumn("ns", first).filter("ns is not null").withColumn("key", F.element_at("groundings", c("ns")))
    rows = rows.join(genes.select(F.lit("HGNC").alias("ns"), c("symbol").alias("key"), c("hgnc_id").alias("gene")), ["ns", "key"], "left")
    rows = rows.join(proteins.select(F.lit("UP").alias("ns"), c("entry").alias("key"), F.lit(True).alias("human"), c("hgnc_id").alias("of"), c("symbol").alias("of_symbol")), ["ns", "key"], "left")
    rows = rows.join(names.select(c("db").alias("ns"), c("id").alias("key"), c("name").alias("known")), ["ns", "key"], "left")
    rows = rows.join(forward.select(F.lit("MESH").alias("ns"), c("mesh_id").alias("key"), c("db").alias("mdb"), c("id").alias("mid"), c("name").alias("mname")), ["ns", "key"], "left")
    ns, mesh = c("ns"), c("ns") == "MESH"
    db = F.when(c("of").isNotNull(), "HGNC").otherwise(F.coalesce("mdb", "ns"))
    id_ = F.when(ns == "HGNC", c("gene")).otherwise(F.coalesce("of", "mid", "key"))
    name = F.when(ns.isin("FPLX", "HGNC"), c("key")).when(ns == "UP", F.coalesce("of_symbol", "key")).otherwise(F.coalesce("mname", "known"))
    organism = F.when((ns == "HGNC") | F.coalesce("human", F.lit(False)), "9606")
    rows = rows.select("text", db.alias("db"), id_.alias("id"), name.alias("name"), organism.alias("organism"), F.when(mesh, "MESH").otherwise(null).alias("sdb"), F.when(mesh, c("key")).alias("sid")).filter("id is not null")
    return to_terms(rows, F.array(entry(c("text"), c("db"), c("id"), c("name"), "curated", "famplex", c("organism"), c("sdb"), c("sid"))))


def uniprot_terms(rows: DataFrame, genes: DataFrame) -> DataFrame:
    """entry, primary, synonyms, names, organism; genes(entry, hgnc_id, symbol) maps human proteins of one gene."""
    c = F.col
    rows = rows.join(genes, "entry", "left").withColumn("proteins", vocab.protein_names("names"))
    rows = rows.withColumn("g", F.split(F.coalesce("primary", F.lit("")), "; ")).withColumn("s", F.split(F.coalesce("synonyms", F.lit("")), "; "))
    many = F.size("g") > 1
    mapped = c("hgnc_id").isNotNull() & ~many
    first = F.when(many, F.get("proteins", F.lit(0))).otherwise(c("g")[0])
    rows = rows.withColumn("on", mapped).filter(first != "").withColumn("standard", F.when(mapped, c("symbol")).otherwise(first))
    one = lambda x, status: entry(x, F.when(c("on"), "HGNC").otherwise("UP"), F.when(c("on"), c("hgnc_id")).otherwise(c("entry")), c("standard"), status, "uniprot", c("organism"), F.when(c("on"), "UP"), F.when(c("on"), c("entry")))
    proteins = F.filter("proteins", lambda x: ~x.startswith("EC ") & (x != c("standard")))
    # lists are read as far as both go
    per_gene = F.flatten(F.transform(F.slice(F.arrays_zip("g", "s"), F.lit(1), F.least(F.size("g"), F.size("s"))), lambda z: F.concat(F.split(z["s"], " "), F.array(F.when(z["g"] != c("standard"), z["g"]).otherwise(F.lit(""))))))
    gene_names = F.when((c("organism") == "9606") & many, F.array().cast("array<string>")).otherwise(F.filter(per_gene, lambda x: x != ""))
    return to_terms(rows, F.concat(F.transform(proteins, lambda x: one(x, "synonym")), F.array(one(c("standard"), "name")), F.transform(gene_names, lambda x: one(x, "synonym"))))


def adeft_terms(rows: DataFrame) -> DataFrame:
    """shortform, grounding ('db:id'), name -> synonyms; prefixes are added to or taken from ids by namespace."""
    rows = rows.filter(F.contains("grounding", F.lit(":")) & (F.col("grounding") != "ungrounded"))
    db, raw = F.split("grounding", ":", 2)[0], F.split("grounding", ":", 2)[1]
    rows = rows.withColumn("db", db).withColumn("raw", raw)
    prefix = F.concat("db", F.lit(":"))
    starts = F.startswith("raw", prefix)
    id_ = F.when(F.col("db").isin("EFO", "NCIT", "OMIT") & starts, F.substr("raw", F.length("db") + 2)).when(F.col("db").isin("BTO", "HP", "DOID") & ~starts, F.concat(prefix, "raw")).otherwise(F.col("raw"))
    return to_terms(rows, F.array(entry(F.col("shortform"), F.col("db"), id_, F.col("name"), "synonym", "adeft"))).distinct()


def obo_terms(rows: DataFrame, prefix: str, mesh_names: DataFrame, forward: DataFrame, reverse: DataFrame, doid: DataFrame, ignore_mappings: bool = False, map_to=("MESH", "DOID")) -> DataFrame:
    """id, name, synonyms, xrefs of one ontology; entries move to MeSH or DOID where they are mapped.

    mesh_names(mesh_id, mesh_name); forward(mesh_id, db, id, name); reverse(db, id, mesh_id, mesh_name);
    doid(doid, doid_name, primary). In turn: the reverse mapping, an xref to a MeSH descriptor, an xref to DOID.
    """
    c, upper = F.col, prefix.upper()
    xref = lambda ns: F.try_element_at(F.filter("xrefs", lambda x: x["namespace"] == ns), F.lit(-1))["id"]
    has_mesh = F.coalesce(xref("MESH"), xref("MSH"))
    rows = rows.select(c("id").alias("oid"), c("name").alias("oname"), F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"), has_mesh.alias("xmesh"), F.when(xref("DOID").startswith("DOID:"), xref("DOID")).otherwise(F.concat(F.lit("DOID:"), xref("DOID"))).alias("xdoid"))
    auto = reverse.filter(c("db") == upper).select(c("id").alias("oid"), c("mesh_id").alias("amesh"), c("mesh_name").alias("amesh_name"))
    rows = rows.join(auto, "oid", "left")
    rows = rows.join(mesh_names.select(c("mesh_id").alias("xmesh"), c("mesh_name").alias("xmesh_name")), "xmesh", "left")
    rows = rows.join(forward.filter(~c("db").isin("EFO", "HP", "DOID")).select(c("mesh_id").alias("xmesh"), c("db").alias("fdb"), c("id").alias("fid"), c("name").alias("fname")), "xmesh", "left")
    d = doid.select(c("doid").alias("xdoid"), F.coalesce("primary", "doid").alias("did"))
    names = doid.select(c("doid").alias("did"), c("doid_name").alias("dname")).filter("dname is not null")
    rows = rows.join(d, "xdoid", "left").join(names, "did", "left")
    use_auto = c("amesh").isNotNull() if not ignore_mappings else F.lit(False)
    in_mesh = c("xmesh").isNotNull() if "MESH" in map_to else F.lit(False)
    to_mesh = in_mesh & c("xmesh").startswith("D") & c("xmesh_name").isNotNull()
    to_doid = ~in_mesh & c("dname").isNotNull() if "DOID" in map_to else F.lit(False)
    choose = lambda a, m, do, own: F.when(use_auto, a).when(to_mesh, m).when(to_doid, do).otherwise(own)
    rows = rows.select(
        "oid", "oname", "synonyms", choose(F.lit("MESH"), F.coalesce("fdb", F.lit("MESH")), F.lit("DOID"), F.lit(upper)).alias("db"),
        choose(c("amesh"), F.coalesce("fid", "xmesh"), c("did"), c("oid")).alias("id"), choose(c("amesh_name"), F.coalesce("fname", "xmesh_name"), c("dname"), c("oname")).alias("entry_name"),
    )
    moved = c("db") != upper
    one = lambda x, status: entry(x, c("db"), c("id"), c("entry_name"), status, prefix, None, F.when(moved, upper), F.when(moved, c("oid")))
    cleaned = F.array_compact(F.transform(F.array_distinct("synonyms"), lambda x: vocab.clean_synonym(x)))
    out = to_terms(rows, F.concat(F.array(one(c("oname"), "name")), F.transform(cleaned, lambda x: one(x, "synonym"))))
    return out.filter(~c("id").startswith("BFO:")) if prefix == "efo" else out


def fragment_terms(rows: DataFrame, organisms=("Human", "SARS-CoV-2")) -> DataFrame:
    """synonym, id ('P..#PRO_..'), organism -> entries of protein fragments of the organisms."""
    c = F.col
    rows = rows.filter(c("id").contains("#") & c("organism").isin(*organisms)).select("synonym", F.split_part("id", F.lit("#"), F.lit(2)).alias("fragment")).distinct()
    return to_terms(rows, F.array(entry(c("synonym"), "UP", c("fragment"), c("synonym"), "synonym", "uniprot")))


def fragment_mappings(synonyms: DataFrame, names: DataFrame, grounder, confidence: float = 0.8, relation: str = "skos:exactMatch") -> DataFrame:
    """synonyms(synonym, id), names(id, name) -> one row an id: prefixes, ids, names, relation, type and confidence.

    A synonym is grounded as it is and without its trailing parentheses; an id's best match is the first of its synonyms'
    in order (column ord), as it is before shortened.
    """
    asked = synonyms.select("id", "ord", F.posexplode(vocab.without_suffix("synonym")).alias("form", "raw")).withColumn("raw", F.trim("raw"))
    best = grounder.ground_best(asked.select("raw")).select("raw", F.col("term.id").alias("target_id"), F.col("term.entry_name").alias("target_name"))
    first = asked.join(best, "raw").groupBy("id").agg(F.min(F.struct("ord", "form", "target_id", "target_name")).alias("m"))
    return first.join(names, "id").select(
        F.lit("pr").alias("source_prefix"), F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.lit(relation).alias("relation"), F.lit("uniprot.chain").alias("target_prefix"),
        "m.target_id", "m.target_name", F.lit("lexical").alias("type"), F.lit(confidence).alias("confidence"),
    )


def all_terms(*sources: DataFrame) -> DataFrame:
    """The union of all sources without duplicates."""
    union = sources[0]
    for s in sources[1:]:
        union = union.unionByName(s)
    return filter_out_duplicates(union)
