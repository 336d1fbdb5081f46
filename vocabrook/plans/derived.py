"""A lexicon, mentions and annotations derived from the driver's tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.lexicon import COLUMNS
from ..sources.tables import reused

#: A few strings with dashes, Greek letters, odd white space, quotes, plurals and numerals.
EXOTIC = (
    "k‐ras", "IFN−γ", "interferon-gamma", "interferon-beta", "Löfgren’s syndrome", "βAR", "xx-1", "xx viii", "xx-iX", "caspase 10", "mosquitoes", "antibodies", "branches", "CDs",
    "receptors", "kinases", "apoptosis", "Straße", "TNF–alpha", "x1x", "Theta wave", "a  b", "BRAF", "aBcd", "Abcd", "A",
)
#: (query, reference) pairs for the match functions.
PAIRS = (
    ("k-ras", "K-ras"), ("k-ras", "KRAS"), ("k-ras", "Kras"), ("ras", "RAs"), ("ras", "ras"), ("Ras", "RA-s"), ("ras", "RAS"), ("mek", "MEK"), ("BRAF", "Braf"), ("Braf", "BRAF"), ("BrAf", "braf"), ("eIF-5A", "EIF5A"),
    ("receptors", "receptor"), ("a b", "ab"), ("mapt protein", "MAPT Protein"), ("T-cell line", "T cell line"), ("IL-2 receptor", "il-2-receptor"), ("Abc De-f", "abc DE-F"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, dealt anew if it has fewer files than Spark has threads: one small file is one task's."""
    docs, threads = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs if len(docs.inputFiles()) >= threads else docs.repartition(threads)


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, nation, region and supplier names as entries; status, organism and source follow from the key."""
    c = F.col
    p = table(spark, sf_dir, "part").select(
        F.when(c("p_partkey") % 3 == 0, c("p_name")).when(c("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.concat(F.upper(F.substr("p_name", F.lit(1), F.lit(1))), F.substr("p_name", F.lit(2)))).alias("text"),
        c("p_type").alias("db"), c("p_size").cast("string").alias("id"), c("p_partkey").alias("k"),
    )
    rows = p
    for name, col, db, key in (("nation", "n_name", "NATION", "n_nationkey"), ("region", "r_name", "REGION", "r_regionkey"), ("supplier", "s_name", "SUPP", "s_suppkey")):
        rows = rows.unionByName(table(spark, sf_dir, name).select(c(col).alias("text"), F.lit(db).alias("db"), c(key).cast("string").alias("id"), c(key).cast("long").alias("k")))
    status = F.element_at(F.array(*[F.lit(s) for s in ("curated", "name", "synonym", "former_name")]), (c("k") % 4 + 1).cast("int"))
    organism = F.when(c("k") % 3 == 0, "9606").when(c("k") % 3 == 1, "10090")
    out = rows.select("text", "db", "id", c("text").alias("entry_name"), status.alias("status"), F.lower("db").alias("source"), organism.alias("organism"), F.when(c("k") % 5 == 0, "XDB").alias("source_db"), F.when(c("k") % 5 == 0, c("k").cast("string")).alias("source_id"))
    return out.withColumn("norm_text", text.normalize("text")).select(*COLUMNS)


def spellings(column: str):
    """Array of a text's spellings: cases, plural, dashes, numerals."""
    c = F.col(column)
    return F.array(c, F.upper(c), F.initcap(c), F.concat(c, F.lit("s")), F.replace(c, F.lit(" "), F.lit("-")), F.concat(c, F.lit(" II")), F.concat(c, F.lit(" 2")), F.concat(F.lit(" "), F.lower(c), F.lit(" ")))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw: spellings of every text of the lexicon."""
    return lexicon(spark, sf_dir).select("text").distinct().select(F.explode(spellings("text")).alias("raw")).distinct()


def word_lexicon(spark: SparkSession, sf_dir: str, least: int = 40, pairs: int = 12, english: bool = False) -> DataFrame:
    """Frequent words of four letters or more and frequent pairs of such words of all documents, as entries.

    english: of English documents and ASCII letters only, as the SQL of `annotations` has it.
    """
    docs = documents(spark, sf_dir)
    docs = docs.filter("lang = 'en'") if english else docs
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+" if english else r"\p{L}+"), F.lit(0))
    long = lambda x: F.length(x) >= 4
    two = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.when(long(a) & long(b), F.concat(a, F.lit(" "), b)))
    none = F.array().cast("array<string>")
    both = F.concat(F.filter("w", long), F.array_compact(F.when(F.size("w") > 1, two).otherwise(none)))
    # words and pairs in one count: only pairs have a space
    rows = docs.select(words.alias("w")).select(F.explode(both).alias("text")).groupBy("text").count()
    often = rows.filter(F.col("count") >= F.when(F.contains("text", F.lit(" ")), pairs).otherwise(least))
    null = F.lit(None).cast("string")
    out = often.select("text", F.lit("WORD").alias("db"), F.col("text").alias("id"), F.col("text").alias("entry_name"), F.lit("name").alias("status"), F.lit("word").alias("source"), null.alias("organism"), null.alias("source_db"), null.alias("source_id"))
    return reused(out.withColumn("norm_text", F.col("text") if english else text.normalize("text")).select(*COLUMNS))
