"""Operations on a whole lexicon: duplicates, ambiguities, summaries, prefix index, cross-vocabulary mappings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lexicon import COLUMNS
from .set_join import classes_by_descent

_RANK = {"curated": 1, "name": 2, "synonym": 3, "former_name": 4}
#: Namespaces in the order in which a mapping target is looked for.
MAPPING_PRIORITY = ("FPLX", "HGNC", "CHEBI", "GO", "DOID", "HP", "EFO")


def status_rank(status="status") -> Column:
    return F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv])[F.col(status)]


def filter_out_duplicates(terms: DataFrame) -> DataFrame:
    """One entry a (db, id, source_db, source_id, text): best status, then own source, then the first by value.

    An aggregation, not a window: the map side combines, and a hot key never meets in one sorted run.
    """
    key = ["db", "id", F.coalesce("source_db", F.lit("")).alias("_sdb"), F.coalesce("source_id", F.lit("")).alias("_sid"), "text"]
    foreign = (~F.coalesce(F.lower("db") == F.lower("source"), F.lit(False))).cast("int")
    rest = [c for c in COLUMNS if c not in ("db", "id", "text")]
    best = F.struct(status_rank().alias("r"), foreign.alias("f"), *rest)
    return terms.groupBy(*key).agg(F.min(best).alias("b")).select(*[c if c in ("db", "id", "text") else F.col(f"b.{c}").alias(c) for c in COLUMNS])


def sorted_terms(terms: DataFrame) -> DataFrame:
    return terms.orderBy("text", "db", "id", "norm_text", "source_db", "source_id")


def ambiguities(terms: DataFrame, skip_names: bool = True, skip_curated: bool = True, skip_name_matches: bool = True, skip_species_ambigs: bool = True) -> DataFrame:
    """Texts with entries of several (db, id): text, n_terms, n_groundings, terms. Texts that an 'adeft' entry has are always left out."""
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    g = terms.groupBy("text").agg(
        F.count("*").alias("n_terms"), F.countDistinct("db", "id").alias("n_groundings"), has(F.col("status") == "name").alias("_name"), has(F.col("status") == "curated").alias("_curated"),
        has(F.col("source") == "adeft").alias("_adeft"), (F.countDistinct(F.lower("entry_name")) == 1).alias("_same"), F.bool_and(F.col("db").isin("HGNC", "UP")).alias("_genes"),
        F.countDistinct(F.coalesce("organism", F.lit(""))).alias("_organisms"), F.sort_array(F.collect_list(F.struct("db", "id", "status", "organism"))).alias("terms"),
    )
    g = g.filter((F.col("n_terms") >= 2) & (F.col("n_groundings") > 1) & ~F.col("_adeft"))
    for on, cond in ((skip_names, F.col("_name")), (skip_curated, F.col("_curated")), (skip_name_matches, F.col("_same")), (skip_species_ambigs, F.col("_genes") & (F.col("_organisms") == F.col("n_terms")))):
        g = g.filter(~cond) if on else g
    return g.select("text", "n_terms", "n_groundings", "terms")


def training_ambiguities(terms: DataFrame, mesh_proteins: DataFrame | None = None, prefix: int = 3) -> DataFrame:
    """Texts to train a model for: text, n_groundings, groundings (distinct, sorted), names.

    Left out are texts with a chemical, a preferred name, a curated or an 'adeft' entry, an entry without a name, and those
    whose entry names share a prefix of so many characters (a family). mesh_proteins(id): MeSH proteins and enzymes, which
    don't count.
    """
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    unwanted = has((F.col("db") == "CHEBI") | F.col("status").isin("name", "curated") | (F.col("source") == "adeft") | F.col("entry_name").isNull())
    protein = F.lit(False)
    if mesh_proteins is not None:
        known = mesh_proteins.select(F.lit("MESH").alias("db"), "id", F.lit(True).alias("is_protein")).distinct()
        terms, protein = terms.select("text", "db", "id", "status", "source", "entry_name").join(known, ["db", "id"], "left"), F.coalesce("is_protein", F.lit(False))
    grounding = F.struct("db", "id")
    g = terms.groupBy("text").agg(
        F.countDistinct("db", "id").alias("all"), unwanted.alias("unwanted"),
        F.sort_array(F.collect_set(F.when(~protein, grounding))).alias("groundings"), F.sort_array(F.collect_set("entry_name")).alias("names"),
    )
    g = g.filter((F.col("all") > 1) & ~F.col("unwanted") & (common_prefix_length(F.col("names")) < prefix) & (F.size("groundings") > 1))
    return g.select("text", F.size("groundings").cast("long").alias("n_groundings"), "groundings", "names")


def rank_ambiguities(ambiguities: DataFrame, counts: DataFrame) -> DataFrame:
    """Ambiguities with the uses n of their texts (0 if unknown), most used first."""
    known = counts.groupBy("text").agg(F.max("n").alias("n"))
    return ambiguities.join(known, "text", "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy(F.desc("n"), "text")


def common_prefix_length(texts: Column) -> Column:
    """Length of the longest common prefix of an array: that of its smallest and largest element."""
    a, b = F.array_min(texts), F.array_max(texts)
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda best, k: F.when((k <= n) & (F.substr(a, F.lit(1), k) == F.substr(b, F.lit(1), k)), k).otherwise(best))


def find_families(groups: DataFrame, names: str = "names", least: int = 3) -> DataFrame:
    return groups.filter(common_prefix_length(F.col(names)) >= least)


def summary(terms: DataFrame) -> DataFrame:
    """One row: lookups, terms, namespaces, and the number of entries of each status."""
    return terms.agg(F.countDistinct("norm_text").alias("lookups"), F.count("*").alias("terms"), F.countDistinct("db").alias("namespaces"), *[F.count_if(F.col("status") == s).alias(s) for s in _RANK])


def status_counts(terms: DataFrame) -> DataFrame:
    return terms.groupBy("status").agg(F.count("*").alias("n_terms"))


def prefix_index(terms: DataFrame) -> DataFrame:
    """first_word, lengths (distinct word counts, ascending) of the norm_texts that begin with it."""
    words = F.filter(F.split("norm_text", r"(?U)\s+"), lambda w: w != "")
    rows = terms.select(words.alias("w")).filter(F.size("w") > 0).select(F.col("w")[0].alias("first_word"), F.size("w").alias("n"))
    return rows.groupBy("first_word").agg(F.sort_array(F.collect_set("n")).alias("lengths"))


# ---- mappings between vocabularies ---------------------------------------------------------------


def mapping_candidates(terms: DataFrame, attribute: str = "text", source: str = "MESH") -> DataFrame:
    """Keys (text or norm_text) of at least two groundings, exactly one of them of the source vocabulary.

    One row an other grounding: key, source_id, source_name, db, id, name. Of several entries of one (db, id), the last
    by status rank and text gives the name.
    """
    one = terms.groupBy(F.col(attribute).alias("key"), "db", "id").agg(F.max(F.struct(status_rank().alias("r"), F.col("text").alias("t"), "entry_name")).alias("b")).select("key", "db", "id", F.col("b.entry_name").alias("name"))
    mine = one.filter(F.col("db") == source).groupBy("key").agg(F.count("*").alias("n"), F.first("id").alias("source_id"), F.first("name").alias("source_name")).filter("n = 1")
    return one.filter(F.col("db") != source).join(mine.drop("n"), "key").select("key", "source_id", "source_name", "db", "id", "name")


#: The class of MeSH entry that a mapping to a namespace asks for.
MAPPING_CLASSES = {"FPLX": "protein", "HGNC": "protein", "CHEBI": "chemical"}
#: Fixed values: (mesh_id, GO id) pairs that are mapped by hand.
MANUAL_GO = (
    ("D002465", "GO:0048870"), ("D002914", "GO:0042627"), ("D012374", "GO:0120200"), ("D014158", "GO:0006351"), ("D014176", "GO:0006412"),
    ("D018919", "GO:0001525"), ("D048708", "GO:0016049"), ("D058750", "GO:0001837"), ("D059767", "GO:0000725"),
)


#: Tree numbers whose descendants are proteins (enzymes included) and chemicals.
CLASS_ROOTS = (("protein", "D12.776"), ("protein", "D08.811"), ("chemical", "D"))


def mesh_classes(nodes: DataFrame) -> DataFrame:
    """nodes(id, tree_number) -> source_id, class, as by_priority() takes them: by descent in the MeSH trees."""
    roots = nodes.sparkSession.createDataFrame(list(CLASS_ROOTS), "class string, tree_number string")
    return classes_by_descent(nodes, roots).select(F.col("id").alias("source_id"), "class")


def by_priority(candidates: DataFrame, priority: Sequence[str] = MAPPING_PRIORITY, classes: DataFrame | None = None) -> DataFrame:
    """The first namespace of the list in which a key has exactly one grounding and whose class the source entry has.

    classes(source_id, class): 'protein' or 'chemical'; without them no class is asked for.
    """
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("db"))
    rows = candidates.withColumn("place", place).filter("place > 0")
    alone = rows.groupBy("key", "db").agg(F.count("*").alias("n")).filter("n = 1").select("key", "db")
    rows = rows.join(alone, ["key", "db"], "left_semi")
    if classes is not None:
        asked = F.create_map(*[F.lit(x) for pair in MAPPING_CLASSES.items() for x in pair])
        known = classes.groupBy("source_id").agg(F.collect_set("class").alias("classes"))
        wanted = F.try_element_at(asked, F.col("db"))
        rows = rows.join(known, "source_id", "left").filter(wanted.isNull() | F.coalesce(F.array_contains("classes", wanted), F.lit(False))).drop("classes")
    best = rows.groupBy("key").agg(F.min(F.struct("place", *candidates.columns)).alias("b"))
    return best.select(*[f"b.{c}" for c in candidates.columns])


def manual_mappings(terms: DataFrame) -> DataFrame:
    """The MANUAL_GO pairs whose entries are both in the lexicon, as mappings."""
    pairs = terms.sparkSession.createDataFrame(list(MANUAL_GO), "source_id string, id string")
    name = lambda db, key, out: terms.filter(F.col("db") == db).groupBy(F.col("id").alias(key)).agg(F.max("entry_name").alias(out))
    rows = pairs.join(name("MESH", "source_id", "source_name"), "source_id").join(name("GO", "id", "name"), "id")
    return rows.select("source_id", "source_name", F.lit("GO").alias("db"), "id", "name")


def build_mappings(terms: DataFrame, classes: DataFrame | None = None, long: int = 6, source: str = "MESH") -> DataFrame:
    """Mappings of source entries to other vocabularies: source_id, source_name, db, id, name.

    By equal texts; for entries without such a mapping by equal normalised texts of more than `long` characters; and for
    those still without, by hand.
    """
    columns = ["source_id", "source_name", "db", "id", "name"]
    out = by_priority(mapping_candidates(terms, "text", source), classes=classes).select(*columns).distinct()
    loose = by_priority(mapping_candidates(terms, "norm_text", source).filter(F.length("key") > long), classes=classes).select(*columns).distinct()
    for more in (loose, manual_mappings(terms)):
        out = out.unionByName(more.join(out.select("source_id").distinct(), "source_id", "left_anti").select(*columns))
    return out


def one_to_one(mappings: DataFrame) -> DataFrame:
    """Pairs (source_id, db, id) that are unique on both sides; of several, a single one with equal names is kept."""
    pairs = mappings.select("source_id", "source_name", "db", "id", "name").distinct()
    same = F.coalesce(F.lower("source_name") == F.lower("name"), F.lit(False))
    pairs = pairs.withColumn("_same", same)
    left, right = Window.partitionBy("source_id"), Window.partitionBy("db", "id")
    for w in (left, right):
        alone = F.count("*").over(w) == 1
        named = F.col("_same") & (F.sum(F.col("_same").cast("int")).over(w) == 1)
        pairs = pairs.withColumn("_keep", alone | named).filter("_keep").drop("_keep")
    return pairs.drop("_same")


def with_overrides(mappings: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Mappings without the negative pairs, and with the positive ones in place of theirs."""
    key = ["source_id", "db", "id"]
    kept = mappings.select(*key).join(negatives.select(*key).distinct(), key, "left_anti").join(positives.select("source_id").distinct(), "source_id", "left_anti")
    return kept.select(*key).unionByName(positives.select(*key).distinct())


def write_mappings(mappings: DataFrame, path: str) -> None:
    """Sorted TSV without those to the source vocabulary itself."""
    mappings.filter("db <> 'MESH'").orderBy("source_id", "db", "id").write.mode("overwrite").options(sep="\t", header=False).csv(path)
