"""Evaluation tables: precision and recall, confusion, cross tables, differences of runs, throughput."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import f1
from ..sources.tables import reused

SPAN = ("doc", "text", "start", "end")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def result_table(rows: DataFrame, group: str = "entity_type", grounded: str = "grounded", correct: str = "correct") -> DataFrame:
    """group and a Total row: n, n_grounded, n_correct, precision, recall (3 places), f1."""
    count = lambda c: F.sum(F.col(c).cast("int"))
    t = rows.rollup(group).agg(F.count("*").alias("n"), count(grounded).alias("n_grounded"), count(correct).alias("n_correct"), F.grouping(group).alias("_g"))
    t = t.withColumn(group, F.when(F.col("_g") == 1, "Total").otherwise(F.col(group))).drop("_g")
    t = t.withColumn("precision", F.round(ratio(F.col("n_correct"), F.col("n_grounded")), 3)).withColumn("recall", F.round(ratio(F.col("n_correct"), F.col("n")), 3))
    return t.withColumn("f1", f1("precision", "recall"))


def mapping_table(rows: DataFrame, left: str = "ref_ns", right: str = "pred_ns", values: list[str] | None = None, total: bool = False) -> DataFrame:
    """Counts of namespace pairs, one column a predicted namespace; total: with a column and a row of sums, 0 for no pair."""
    counts = rows.groupBy(left).pivot(right, values).count()
    if not total:
        return counts
    columns = [c for c in counts.columns if c != left]
    counts = counts.na.fill(0, columns).withColumn("Total", sum((F.col(c) for c in columns), F.lit(0)).cast("long"))
    sums = counts.agg(*[F.sum(c).alias(c) for c in [*columns, "Total"]]).filter("Total is not null").select(F.lit("Total").alias(left), *columns, "Total")
    return counts.unionByName(sums)


def unique_mapping_table(rows: DataFrame, key: str = "text", left: str = "ref_ns", right: str = "pred_ns", values: list[str] | None = None, total: bool = False) -> DataFrame:
    """As mapping_table(), of distinct keys."""
    return mapping_table(rows.select(left, right, key).distinct(), left, right, values, total)


def annotation_counts(gold: DataFrame, found: DataFrame, key=SPAN) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of spans, by semi and anti joins on the key."""
    gold, found = gold.select(*key).distinct(), found.select(*key).distinct()
    tags = found.withColumn("_f", F.lit(1)).join(gold.withColumn("_g", F.lit(1)), list(key), "full")
    t = tags.agg(F.count_if(F.col("_f").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn"))
    t = t.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return t.withColumn("f1", f1("precision", "recall"))


def top_false_positives(gold: DataFrame, found: DataFrame, key=SPAN, k: int = 50) -> DataFrame:
    wrong = found.join(gold.select(*key).distinct(), list(key), "left_anti")
    return wrong.groupBy("text").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "text").limit(k)


def false_negatives(gold: DataFrame, found: DataFrame, key=SPAN) -> DataFrame:
    return gold.join(found.select(*key).distinct(), list(key), "left_anti")


def confusion(rows: DataFrame, gold: str = "gold", predicted: str = "predicted", classes: list | None = None) -> DataFrame:
    """Counts of (gold, predicted) with a null as 'unknown'."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)
    return rows.select(name(gold), name(predicted)).groupBy(gold).pivot(predicted, classes).count()


def bounds(matrix: DataFrame, correct=("correct",), unknown=("unknown",)) -> DataFrame:
    """gold, predicted, n rows of a confusion -> one row: n, lower (known to be right) and upper (unknown ones right too) accuracy."""
    n = F.sum("n")
    right = F.sum(F.when(F.col("predicted").isin(*correct), F.col("n")).otherwise(0))
    maybe = F.sum(F.when(F.col("predicted").isin(*unknown), F.col("n")).otherwise(0))
    return matrix.agg(n.alias("n"), ratio(right, n).alias("lower"), ratio(right + maybe, n).alias("upper"))


#: What a curated grounding was, and what a new one is against it.
OLD, NEW = ("ungrounded", "correct", "incorrect"), ("ungrounded", "unknown", "correct", "incorrect")


def old_status(db_refs="db_refs", correct="correct") -> Column:
    return F.when(F.coalesce(F.size(F.map_keys(db_refs)), F.lit(0)) == 0, "ungrounded").when(F.col(correct), "correct").otherwise("incorrect")


def new_status(rows: DataFrame, assertions: DataFrame | None = None) -> DataFrame:
    """rows(text, db_refs, correct, db, id) with `new`, the state of the grounding (db, id; null: none) against the curated one.

    assertions(text, db, id, right): groundings of a text known to be right or wrong; they come first, the right ones before.
    A grounding that the curated row has shares its verdict; any other one is unknown.
    """
    said = F.lit(None).cast("boolean")
    if assertions is not None:
        known = assertions.groupBy("text", "db", "id").agg(F.bool_or("right").alias("said"))
        rows, said = rows.join(known, ["text", "db", "id"], "left"), F.col("said")
    same = F.coalesce(F.try_element_at("db_refs", F.col("db")) == F.col("id"), F.lit(False))
    state = F.when(F.col("db").isNull(), "ungrounded").when(said, "correct").when(~said, "incorrect").when(same & F.col("correct"), "correct").when(same, "incorrect").otherwise("unknown")
    return rows.withColumn("new", state).drop("said")


def comparison_matrix(rows: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """old, new, n: all twelve pairs of OLD and NEW, also those without rows."""
    pairs = rows.sparkSession.createDataFrame([(a, b) for a in OLD for b in NEW], "old string, new string")
    counts = rows.groupBy(F.col(old).alias("old"), F.col(new).alias("new")).agg(F.count("*").alias("n"))
    return pairs.join(counts, ["old", "new"], "left").select("old", "new", F.coalesce("n", F.lit(0)).alias("n"))


def comparison_bounds(matrix: DataFrame) -> DataFrame:
    """old, new, n -> three rows: precision, recall, f1 of the reference, and the least and largest of the current groundings.

    Unknown ones are all wrong for the least, all right for the largest; one aggregation gives all counts.
    """
    count = lambda c, x: F.sum(F.when(F.col(c) == x, F.col("n")).otherwise(0))
    t = matrix.agg(*[count("old", x).alias(f"old_{x}") for x in OLD], *[count("new", x).alias(f"new_{x}") for x in NEW])
    c = {x: F.col(f"new_{x}") for x in NEW}
    told = c["correct"] + c["incorrect"] + c["unknown"]
    bound = lambda name, p, r: F.struct(F.lit(name).alias("trial"), p.alias("precision"), r.alias("recall"))
    rows = F.array(
        bound("reference", ratio(F.col("old_correct"), F.col("old_correct") + F.col("old_incorrect")), ratio(F.col("old_correct"), F.col("old_correct") + F.col("old_ungrounded"))),
        bound("least", ratio(c["correct"], told), ratio(c["correct"], c["correct"] + c["ungrounded"])),
        bound("largest", ratio(c["correct"] + c["unknown"], told), ratio(c["correct"] + c["unknown"], c["correct"] + c["unknown"] + c["ungrounded"])),
    )
    return t.select(F.explode(rows).alias("x")).select("x.*").withColumn("f1", f1("precision", "recall"))


def ner_evaluation(gold: DataFrame, found: DataFrame, key=("doc", "figure", "text", "start", "end")) -> DataFrame:
    """gold(key.., curies), found(key.., matches), arrays, the matches best first -> two rows, match_type 'all' and 'top': tp, fp, fn,
    precision, recall, f1.

    curies holds a gold annotation's own ids and all that may stand for them (set_join.synonym_sets). An annotation is right
    if any match is a curie of a gold annotation of the same span, right at the top if the first one is; it is wrong if none
    is. A gold annotation is missed if no annotation of its span has one of its curies; repeated rows count each.
    """
    key = list(key)
    right = gold.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_set("curies"))).alias("right"))
    there = found.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_set("matches"))).alias("there"))
    no = lambda c: F.coalesce(c, F.lit(False))
    hit = found.join(right, key, "left").select(no(F.arrays_overlap("right", "matches")).alias("any"), no(F.array_contains("right", F.get("matches", F.lit(0)))).alias("top"))
    missed = gold.join(there, key, "left").agg(F.count_if(~no(F.arrays_overlap("curies", "there"))).alias("fn"))
    t = hit.agg(F.count_if("any").alias("tp_all"), F.count_if("top").alias("tp_top"), F.count_if(~F.col("any")).alias("fp")).join(F.broadcast(missed))
    rows = t.select(F.explode(F.array(*[F.struct(F.lit(x).alias("match_type"), F.col(f"tp_{x}").alias("tp"), "fp", "fn") for x in ("all", "top")])).alias("x")).select("x.*")
    rows = rows.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return rows.withColumn("f1", f1("precision", "recall"))


def correctness(rows: DataFrame, gold: str = "gold", groundings: str = "groundings", members: DataFrame | None = None, ancestors: DataFrame | None = None) -> DataFrame:
    """top_correct and exists_correct; gold an array of curies, groundings an array, best first.

    members(child, ancestor): members of families; with them *_correct_family, where a family stands for its members.
    ancestors(child, ancestor), as of closure(): with them *_correct_loose, where either may be the other's ancestor.
    The pairs of each row are looked up once, all rows in one join.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    out = rows.withColumn("top_correct", no(F.array_contains(F.col(gold), F.get(groundings, F.lit(0))))).withColumn("exists_correct", no(F.arrays_overlap(gold, groundings)))
    for edges, name, both_ways in ((members, "family", False), (ancestors, "loose", True)):
        if edges is not None:
            out = _related(out, gold, groundings, edges, name, both_ways)
    return out


def _related(rows: DataFrame, gold: str, groundings: str, edges: DataFrame, name: str, both_ways: bool) -> DataFrame:
    """rows with top_correct_{name} and exists_correct_{name}: a gold curie equals a grounding or lies below it (or above)."""
    edges = edges.select("child", "ancestor").distinct()
    up = edges if not both_ways else edges.unionByName(edges.select(F.col("ancestor").alias("child"), F.col("child").alias("ancestor"))).distinct()
    near = up.groupBy(F.col("child").alias("curie")).agg(F.collect_set("ancestor").alias("also"))
    golds = rows.select(F.col(gold).alias("g")).distinct()
    wide = golds.select("g", F.explode("g").alias("curie")).join(near, "curie", "left").groupBy("g").agg(F.array_distinct(F.concat(F.first("g"), F.flatten(F.collect_list(F.coalesce("also", F.array().cast("array<string>")))))).alias("wide"))
    packed = rows.select(F.struct(*rows.columns).alias("row"), F.col(gold).alias("g")).join(wide, "g", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    found = F.col("row").getField(groundings)
    return packed.select(
        *[F.col("row").getField(c).alias(c) for c in rows.columns],
        no(F.array_contains(F.col("wide"), F.get(found, F.lit(0)))).alias(f"top_correct_{name}"), no(F.arrays_overlap("wide", found)).alias(f"exists_correct_{name}"),
    )


def namespace_breakdown(rows: DataFrame, namespace: str = "HGNC", gold: str = "gold", groundings: str = "groundings", correct: str = "top_correct") -> DataFrame:
    """One row of one namespace: tp and fp of best groundings in it, gold rows in it, precision, recall, f1."""
    mine = F.coalesce(F.get(groundings, F.lit(0)).startswith(namespace), F.lit(False))
    t = rows.agg(F.count_if(mine & F.col(correct)).alias("tp"), F.count_if(mine & ~F.col(correct)).alias("fp"), F.count_if(F.exists(gold, lambda x: x.startswith(namespace))).alias("positives"))
    t = t.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("positives")))
    return t.withColumn("f1", f1("precision", "recall"))


def equivalents(curies: DataFrame, *links: DataFrame) -> DataFrame:
    """curie -> curie, equivalents (sorted, itself included); links(curie, other): cross references, gene maps, user's pairs."""
    pairs = curies.select("curie", F.col("curie").alias("other"))
    for link in links:
        pairs = pairs.unionByName(curies.join(link.select("curie", "other"), "curie"))
    return pairs.groupBy("curie").agg(F.sort_array(F.collect_set("other")).alias("equivalents"))


def family_members(members: DataFrame, current: DataFrame) -> DataFrame:
    """family, members: the sets of a family's genes by their current ids; members(family, db, id), current(id, current_id)."""
    rows = members.filter("db = 'HGNC'").join(current, "id").filter("current_id is not null")
    return rows.groupBy("family").agg(F.sort_array(F.collect_set(F.concat(F.lit("HGNC:"), "current_id"))).alias("members"))


def single_xrefs(nodes: DataFrame, prefix: str = "MESH", known: DataFrame | None = None) -> DataFrame:
    """id, other: nodes(id, xrefs array<string>) with exactly one cross reference of a vocabulary; known(id): its ids."""
    xrefs = F.filter("xrefs", lambda x: x.startswith(prefix))
    rows = nodes.select("id", xrefs.alias("x")).filter(F.size("x") == 1).select("id", F.col("x")[0].alias("other"))
    if known is not None:
        rows = rows.join(known.select(F.concat(F.lit(f"{prefix}:"), "id").alias("other")).distinct(), "other", "left_semi").select("id", "other")
    return rows


def positional(left: DataFrame, right: DataFrame, key: str, column: str = "entities") -> DataFrame:
    """key, ord, a, b: the items of two arrays side by side, as far as both go."""
    both = left.select(key, F.col(column).alias("l")).join(right.select(key, F.col(column).alias("r")), key)
    n = F.least(F.size("l"), F.size("r"))
    return both.select(key, F.posexplode(F.arrays_zip(F.slice("l", F.lit(1), n).alias("a"), F.slice("r", F.lit(1), n).alias("b"))).alias("ord", "x")).select(key, "ord", "x.a", "x.b")


def agreement(a: Column, b: Column) -> Column:
    """The class of two groundings (null: ungrounded) of one mention."""
    return (
        F.when(a.isNull() & b.isNull(), "ungrounded_ungrounded").when(a.isNull(), "ungrounded_grounded").when(b.isNull(), "grounded_ungrounded")
        .when(a == b, "grounded_matching").otherwise("grounded_different")
    )


def run_difference(old: DataFrame, new: DataFrame, key: str = "row", value: str = "curie") -> DataFrame:
    """key, old, new, change: 'same', 'changed', 'gained' or 'lost'; rows without either are left out."""
    both = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key, "full")
    change = F.when(F.col("old").eqNullSafe(F.col("new")), "same").when(F.col("old").isNull(), "gained").when(F.col("new").isNull(), "lost").otherwise("changed")
    return both.withColumn("change", change).filter("old is not null or new is not null")


def throughput(rows: DataFrame) -> DataFrame:
    """type, context, trial, duration -> mean and sample deviation of responses a second, one place."""
    rate = 1.0 / F.col("duration")
    return rows.filter("duration > 0").groupBy("type", "context").agg(F.round(F.avg(rate), 1).alias("mean"), F.round(F.stddev_samp(rate), 1).alias("std"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def group_synonyms(rows: DataFrame, keys=("article", "text"), synonyms: str = "synonyms") -> DataFrame:
    """The union of the synonym arrays of a group."""
    return rows.groupBy(*keys).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set(synonyms)))).alias(synonyms))


def organism_order(annotated: Column, popular: list[str]) -> Column:
    """An order for grounding: the popular organisms that a paper is annotated with, then the other popular ones, each in their own order."""
    liked, there = F.array(*[F.lit(p) for p in popular]), F.coalesce(annotated, F.array().cast("array<string>"))
    return F.concat(F.filter(liked, lambda x: F.array_contains(there, x)), F.filter(liked, lambda x: ~F.array_contains(there, x)))


def closure(edges: DataFrame, steps: int = 32) -> DataFrame:
    """child, ancestor of an is-a graph by doubling: few joins, and each step's rows are a table of their own (reused())."""
    now = edges.select(F.col("child"), F.col("parent").alias("ancestor")).distinct()
    n = now.count()
    for _ in range(steps):
        longer = now.alias("a").join(now.alias("b"), F.col("a.ancestor") == F.col("b.child")).select("a.child", "b.ancestor")
        now = reused(now.unionByName(longer).distinct())
        m = now.count()
        if m == n:
            break
        n = m
    return now


def model_histogram(models: DataFrame, bins: int = 20) -> DataFrame:
    """bin (lower edge), n of the models' F1 values."""
    return models.groupBy((F.floor(F.col("f1") * bins) / bins).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin")


def sampled(rows: DataFrame, n: int, seed: int = 1) -> DataFrame:
    return rows.orderBy(F.rand(seed)).limit(n)


def trials(rows: DataFrame, n: int, times: int = 2, seed: int = 1) -> DataFrame:
    """trial (from 1) and the columns of rows: a sample of n rows for each of several trials."""
    out = [sampled(rows, n, seed + t).select(F.lit(t + 1).alias("trial"), "*") for t in range(times)]
    return reduce(DataFrame.unionByName, out)


def batched(rows: DataFrame, column: str, size: int = 100) -> DataFrame:
    """batch, items: the values of a column in arrays of `size` at most, as ground_lists() takes them.

    Batches are made of neighbouring rows of a partition, so that nothing has to be counted over all of them.
    """
    at = F.monotonically_increasing_id()
    dealt = rows.select(at.alias("at"), F.col(column).alias("item"))
    batch = F.concat_ws("-", F.shiftright("at", 33), F.floor((F.col("at") % (1 << 33)) / size))
    one = F.array_sort(F.collect_list(F.struct("at", "item")))
    return dealt.groupBy(batch.alias("batch")).agg(F.transform(one, lambda x: x["item"]).alias("items"))


def table_lines(table: DataFrame, *order: str, kind: str = "latex") -> DataFrame:
    """line: the rows of a small result table as text, in order, behind a head; kind 'latex' or 'markdown'. Nulls are empty."""
    cell = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns]
    left, between, right = ("", " & ", " \\\\") if kind == "latex" else ("| ", " | ", " |")
    names = left + between.join(table.columns) + right
    head = [names] if kind == "latex" else [names, "|" + "---|" * len(table.columns)]
    rows = table.orderBy(*order) if order else table
    lines = rows.select(F.concat(F.lit(left), F.concat_ws(between, *cell), F.lit(right)).alias("line"))
    return table.sparkSession.createDataFrame([(x,) for x in head], "line string").coalesce(1).unionByName(lines.coalesce(1))
