"""Grounding: strings to identifiers of a lexicon.

Queries are made distinct, expanded into look-up variants, joined to the lexicon's distinct texts on norm_text and scored:
a string meets a text once, however many entries the text has. The entries are attached to the scored pairs afterwards,
filtered by organism priority, merged by (db, id), re-weighted by context models, ranked and filtered by namespace. All of
it is one lazy plan: the join shuffles on norm_text (not at all for a bucketed or small lexicon), the rest on the query.

An order of organisms is one list for all rows, or a column of arrays. Of a column, each string's entries are filtered and
merged once for every organism that comes out best, not once for every order.

Where several entries of one (db, id) have equal scores, the first by (text, status, source, organism, source_db,
source_id) comes first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import curie, scoring, text
from ..sources import lexicon

#: Namespaces by falling priority, and the organism that is meant when none is named.
NAMESPACE_PRIORITY = ("FPLX", "HGNC", "UP", "CHEBI", "GO", "MESH", "DOID", "HP", "EFO")
DEFAULT_ORGANISMS = ("9606",)


def context_key(context) -> Column:
    """A 128-bit digest that stands for a context in joins and groups, so that its text never enters them."""
    return F.md5(F.col(context) if isinstance(context, str) else context)


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def filter_for_organism(candidates: DataFrame, organisms: Sequence[str] | None = None, key: str = "raw", organism: str = "organism") -> DataFrame:
    """Entries without an organism, and those of the first listed organism that any entry of the query has."""
    position = F.nullif(F.array_position(strings(organisms or DEFAULT_ORGANISMS), F.col(organism)), F.lit(0))
    best = F.min("_place").over(Window.partitionBy(key))
    rows = candidates.withColumn("_place", position).filter(F.col(organism).isNull() | F.col("_place").isNotNull())
    return rows.withColumn("_best", best).filter(F.col(organism).isNull() | (F.col("_place") == F.col("_best"))).drop("_place", "_best")


def best_organisms(candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """candidates(raw, organism, ..), asked(raw, organisms) -> raw, organisms, best: the first of its order that an entry has, or null.

    Entries are made distinct (raw, organism) pairs first, so a string's orders meet its organisms, not its entries.
    """
    there = candidates.filter("organism is not null").select("raw", "organism").distinct()
    place = F.nullif(F.array_position("organisms", F.col("organism")), F.lit(0))
    first = F.min(F.when(place.isNotNull(), F.struct(place.alias("place"), "organism")))
    met = asked.select("raw", "organisms").distinct().hint("merge").join(there, "raw", "left").groupBy("raw", "organisms").agg(first.alias("first"))
    return met.select("raw", "organisms", F.col("first.organism").alias("best"))


def stripped(column) -> Column:
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def order_of(column) -> Column:
    """A row's order of organisms; the usual one where it is null or empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.size(c) > 0, c).otherwise(strings(DEFAULT_ORGANISMS))


class Grounder:
    """A lexicon with the operations on it. terms: whatever sources.lexicon.load() takes."""

    def __init__(self, spark: SparkSession, terms, namespace_priority: Sequence[str] | None = None, models: DataFrame | None = None, variants: bool = True):
        self.spark, self.terms = spark, lexicon.load(spark, terms)
        #: Whether a string is looked up under its spelling variants too, or under its own normalised form only.
        self.variants = variants
        self.namespace_priority = NAMESPACE_PRIORITY if namespace_priority is None else tuple(namespace_priority)
        #: surface, kind ('adeft' or 'own'), label, feature, weight; see disambiguation.
        self.models = models

    # -- look-up

    def keys(self, queries: DataFrame, column: str = "raw") -> DataFrame:
        """raw, norm_text: each distinct string with the forms under which it is looked up."""
        forms = text.lookups("raw") if self.variants else F.array(text.normalize("raw"))
        return queries.select(F.col(column).alias("raw")).distinct().select("raw", F.explode(forms).alias("norm_text"))

    def lookup(self, queries: DataFrame, column: str = "raw") -> DataFrame:
        """Distinct strings -> raw and the columns of the entries that any of its variants finds.

        Both sides are dealt by norm_text, never broadcast: Spark guesses the size of exploded keys from a compressed file.
        A bucketed lexicon is not moved.
        """
        return self.keys(queries, column).hint("merge").join(self.terms, "norm_text")

    def pairs(self, queries: DataFrame, column: str = "raw") -> DataFrame:
        """raw, norm_text, text, match, string_score: each string with each distinct text that it meets, scored once."""
        met = self.keys(queries, column).hint("merge").join(self.terms.select("norm_text", "text").distinct(), "norm_text")
        return met.withColumn("match", scoring.generate_match("raw", "text")).withColumn("string_score", scoring.score_string_match("match"))

    def entries(self, queries: DataFrame) -> DataFrame:
        """raw with each entry it meets, its match, string score and score."""
        terms = self.terms.withColumnsRenamed({"norm_text": "_norm", "text": "_text"})
        # both sides lie by norm_text already; a comparison that is no equality of keys leaves them there
        same = (F.col("norm_text") == F.col("_norm")) & (F.col("text") >= F.col("_text")) & (F.col("text") <= F.col("_text"))
        rows = self.pairs(queries).hint("merge").join(terms, same).drop("_norm", "_text")
        return rows.withColumn("score", scoring.score("string_score", "status"))

    def candidates(self, queries: DataFrame, organisms: Sequence[str] | None = None) -> DataFrame:
        """The entries, those of other organisms than the first one listed that there is left out."""
        return filter_for_organism(self.entries(queries), organisms)

    def matched(self, asked: DataFrame, organisms: Sequence[str] | None = None) -> DataFrame:
        """asked(raw, and organisms if each row has its own order) with its merged matches, a row a (raw, organisms, db, id)."""
        if "organisms" not in asked.columns:
            return self.merge(self.candidates(asked, organisms))
        rows = self.entries(asked)
        best = best_organisms(rows, asked)
        wanted = best.select("raw", "best").distinct()
        kept = rows.hint("merge").join(wanted, "raw").filter(F.col("organism").isNull() | (F.col("organism") == F.col("best")))
        merged = self.merge(kept, "raw", "best").withColumnsRenamed({"raw": "_raw", "best": "_best"})
        same = (F.col("raw") == F.col("_raw")) & F.col("best").eqNullSafe(F.col("_best"))
        return best.hint("merge").join(merged, same).drop("_raw", "_best", "best")

    # -- merge, rank

    def priority(self, db="db") -> Column:
        if not self.namespace_priority:
            return F.lit(0)
        n, listed = len(self.namespace_priority), strings(self.namespace_priority)
        at = F.array_position(listed, F.col(db) if isinstance(db, str) else db)
        return F.when(at > 0, F.lit(n + 1) - at).otherwise(F.lit(0))

    @staticmethod
    def merge(scored: DataFrame, *key: str) -> DataFrame:
        """One row a (raw, db, id): the best entry, and the others as subsumed terms by falling score. key: what stands for raw."""
        key = key or ("raw",)
        order = F.struct((-F.col("score")).alias("s"), "text", "status", "source", "organism", "source_db", "source_id", "norm_text", "entry_name", "match", "string_score")
        groups = scored.groupBy(*key, "db", "id").agg(F.array_sort(F.collect_list(order)).alias("all"))
        best = F.col("all")[0]
        term = lambda x, db, id_: F.struct(x["norm_text"].alias("norm_text"), x["text"].alias("text"), db.alias("db"), id_.alias("id"), x["entry_name"].alias("entry_name"), x["status"].alias("status"), x["source"].alias("source"), x["organism"].alias("organism"), x["source_db"].alias("source_db"), x["source_id"].alias("source_id"))
        rest = F.transform(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))), lambda x: term(x, F.col("db"), F.col("id")))
        out = groups.select(
            *key, "db", "id", term(best, F.col("db"), F.col("id")).alias("term"), best["match"].alias("match"), (-best["s"]).alias("score"), rest.alias("subsumed_terms"),
        )
        return out.withColumn("namespaces", curie.match_namespaces(F.col("term"), F.col("subsumed_terms")))

    @staticmethod
    def question(rows: DataFrame) -> list[str]:
        """What a match answers: a string, in a context, for an order of organisms."""
        return ["raw", *[c for c in ("context_key", "organisms") if c in rows.columns]]

    def rank(self, merged: DataFrame) -> DataFrame:
        order = Window.partitionBy(*self.question(merged)).orderBy(F.desc("score"), F.desc(self.priority()), "db", "id")
        return merged.withColumn("rank", F.row_number().over(order))

    def ground(self, queries: DataFrame, column: str = "raw", organisms: Sequence[str] | str | None = None, namespaces: Sequence[str] | None = None, context: str | None = None) -> DataFrame:
        """One row a distinct (stripped) string, context, order and (db, id): term, match, score, subsumed_terms, rank (from 1), url.

        organisms: a list for all rows, or the name of a column of arrays, which is returned as `organisms` then. A context is
        returned as its context_key(). The namespace filter comes after merging and ranking and looks at all namespaces of a match.
        """
        asked, organisms = self._asked(queries, column, organisms, context)
        if context:
            return self.ground_in(asked, queries.select(context_key(context).alias("context_key"), F.col(context).alias("context")), organisms, namespaces)
        return self._ranked(self.matched(asked, organisms), namespaces)

    @staticmethod
    def _keys(column, organisms, context) -> dict[str, Column]:
        return {"raw": stripped(column)} | ({"context_key": context_key(context)} if context else {}) | ({"organisms": order_of(organisms)} if isinstance(organisms, str) else {})

    def _asked(self, queries: DataFrame, column, organisms, context) -> tuple[DataFrame, Sequence[str] | None]:
        keys = self._keys(column, organisms, context)
        rows = queries.select(*[v.alias(k) for k, v in keys.items()]).filter("raw is not null").distinct()
        return rows, None if isinstance(organisms, str) else organisms

    def ground_in(self, asked: DataFrame, contexts: DataFrame, organisms: Sequence[str] | None = None, namespaces: Sequence[str] | None = None) -> DataFrame:
        """asked(raw, context_key, and organisms if a row has its own order), contexts(context_key, context) -> as ground().

        A string is matched once, whatever its contexts.
        """
        from .disambiguation import disambiguate

        asked = asked.distinct()
        apart = [c for c in ("raw", "organisms") if c in asked.columns]
        merged = asked.hint("merge").join(self.matched(asked.select(*apart).distinct(), organisms), apart)
        return self._ranked(disambiguate(merged, contexts, self.models), namespaces)

    def _ranked(self, merged: DataFrame, namespaces: Sequence[str] | None) -> DataFrame:
        ranked = self.rank(merged)
        if namespaces:
            ranked = ranked.filter(F.arrays_overlap("namespaces", strings(namespaces)))
            # ranks count the matches that are left
            key = Window.partitionBy(*self.question(merged)).orderBy("rank")
            ranked = ranked.withColumn("rank", F.row_number().over(key))
        return ranked.withColumn("curie", curie.get_curie("db", "id")).withColumn("url", curie.get_bioregistry_url("db", "id"))

    def ground_best(self, queries: DataFrame, column: str = "raw", **options) -> DataFrame:
        return self.ground(queries, column, **options).filter("rank = 1")

    def _with_answers(self, df: DataFrame, answers: DataFrame, target: str, column, organisms, context) -> DataFrame:
        """df with the column `target` of answers (question.., target). The row stays whole in a column, so that no names clash."""
        keys = self._keys(column, organisms, context)
        rows = df.select(F.struct(*df.columns).alias("row"), *[v.alias(k) for k, v in keys.items()]).join(answers.select(*keys, F.col(target).alias("answer")), list(keys), "left")
        return rows.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c != target], F.col("answer").alias(target))

    def ground_column(self, df: DataFrame, column: str, target: str | None = None, organisms: Sequence[str] | str | None = None, context: str | None = None, **options) -> DataFrame:
        """df with the CURIE of each value's best match (null where there is none); values are grounded once."""
        target = target or f"{column}_grounded"
        best = self.ground_best(df, column, organisms=organisms, context=context, **options)
        return self._with_answers(df, best.withColumn(target, F.col("curie")), target, column, organisms, context)

    def ground_entities(self, df: DataFrame, column: str, organisms: str, context: str | None = None) -> DataFrame:
        """df with two columns, each an array of (curie, score), best first, empty where there is no match: groundings_no_context, with
        the usual organism and no context, and groundings, with each row's order of organisms and, if one is given, its context."""

        def listed(name, **options):
            found = self.ground(df, column, **options)
            one = F.array_sort(F.collect_list(F.struct("rank", "curie", "score")))
            return found.groupBy(*self.question(found)).agg(F.transform(one, lambda x: F.struct(x["curie"].alias("curie"), x["score"].alias("score"))).alias(name))

        out = df
        for name, options in (("groundings_no_context", {"organisms": None, "context": None}), ("groundings", {"organisms": organisms, "context": context})):
            out = self._with_answers(out, listed(name, **options), name, column, **options)
            out = out.withColumn(name, F.coalesce(name, F.array().cast("array<struct<curie:string,score:double>>")))
        return out

    def ground_lists(self, batches: DataFrame, id_: str, column: str, **options) -> DataFrame:
        """id, array of strings -> id, array (in order) of JSON arrays of matches."""
        items = batches.select(id_, F.posexplode_outer(column).alias("ord", "raw"))
        best = self.ground(items.select("raw"), **options).groupBy("raw").agg(F.array_sort(F.collect_list(F.struct("rank", "curie", "score"))).alias("matches"))
        named = items.withColumn("_k", stripped("raw")).join(best.withColumnRenamed("raw", "_k"), "_k", "left")
        one = F.struct("ord", F.coalesce(F.to_json("matches"), F.lit("[]")).alias("json"))
        return named.groupBy(id_).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["json"]).alias("matches"))

    def ground_text(self, raw: str, **options) -> DataFrame:
        """The matches of one string; context is a string."""
        context = options.pop("context", None)
        row = self.spark.createDataFrame([(raw, context)], "raw string, context string")
        return self.ground(row, context="context" if context else None, **options).orderBy("rank")

    # -- catalogue

    def get_names(self, db: str, id_: str, status: str | None = None, source: str | None = None) -> DataFrame:
        rows = self.terms.filter((F.col("db") == db) & (F.col("id") == id_))
        rows = rows.filter(F.col("status") == status) if status else rows
        rows = rows.filter(F.col("source") == source) if source else rows
        return rows.select("text").distinct().orderBy("text")

    def get_models(self) -> DataFrame:
        """The surfaces that have a model; none without models."""
        if self.models is None:
            return self.spark.createDataFrame([], "surface string")
        return self.models.select("surface").distinct().orderBy("surface")


def match_json(matches: DataFrame) -> DataFrame:
    """raw, rank, json of each match; absent parts are left out."""
    subsumed = F.when(F.size("subsumed_terms") > 0, F.col("subsumed_terms"))
    fields = ["term", "url", "score", "match", *(["disambiguation"] if "disambiguation" in matches.columns else [])]
    return matches.select("raw", "rank", F.to_json(F.struct(*fields, subsumed.alias("subsumed_terms"))).alias("json"))
