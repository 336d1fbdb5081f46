"""Joins of sets by containment, and of tree nodes by descent, as equality joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import reused


#: Longs of 64 bits in which a set's elements leave a mark each.
MARKS = 2


def _marks() -> list[Column]:
    """Which of the 64 * MARKS marks the items of a group have."""
    bit = F.pmod(F.xxhash64("item"), F.lit(64 * MARKS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    return [F.bit_or(F.when(F.floor(bit / 64) == k, one).otherwise(F.lit(0).cast("long"))) for k in range(MARKS)]


def contained_sets(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """needles(needle, item), haystacks(hay, item), a row an element -> needle, hay: all elements of the one are among the other's.

    A needle is looked up by its rarest element only, in an index of the haystacks; the candidates' other elements are
    counted. Marks of a few bits that a haystack's elements leave drop most candidates where they are found: one without a
    mark of the needle lacks an element. Sets are rows throughout, so neither a set nor an element's haystacks has to fit in
    one row. A set without elements has no rows and is in none; a needle with an element that no haystack has is dropped
    before the look-up.
    """
    # dealt by their sets once, so that what is said of a set needs no other exchange; haystacks are read four times
    needles, haystacks = needles.select("needle", "item").repartition("needle").distinct(), reused(haystacks.select("hay", "item").repartition("hay").distinct())
    marks = _marks()
    often = haystacks.groupBy("item").agg(F.count("*").alias("often"))
    sizes = needles.hint("merge").join(often, "item", "left").groupBy("needle").agg(
        F.count("*").alias("size"), F.count("often").alias("known"), F.min(F.struct("often", "item")).alias("rarest"),
    )
    sizes = sizes.filter("known = size").select("needle", "size", F.col("rarest.item").alias("item"))
    # read twice: for sets of one element, and of several
    sizes = reused(sizes.hint("merge").join(needles.groupBy("needle").agg(*[m.alias(f"n_{k}") for k, m in enumerate(marks)]), "needle"))
    names = [f"_{k}" for k in range(MARKS)]
    marked = haystacks.withColumns({c: m.over(Window.partitionBy("hay")) for c, m in zip(names, marks, strict=True)})
    within = [F.col(f"n{c}").bitwiseAND(F.col(c)) == F.col(f"n{c}") for c in names]
    alone = sizes.filter("size = 1").select("needle", "item").hint("merge").join(haystacks, "item").select("needle", "hay")
    found = sizes.filter("size > 1").hint("merge").join(marked, "item").filter(reduce(Column.__and__, within)).select("needle", "hay", "size", F.col("item").alias("rarest"))
    rest = found.hint("merge").join(needles, "needle").filter("item <> rarest")
    full = rest.hint("merge").join(haystacks, ["hay", "item"], "left_semi").groupBy("needle", "hay", "size").agg(F.count("*").alias("met")).filter("met = size - 1")
    return alone.unionByName(full.select("needle", "hay"))


def synonym_sets(golds: DataFrame, links: list[DataFrame], families: DataFrame | None = None, prefix: str = "FPLX") -> DataFrame:
    """golds(curies array) -> curies, synonyms: what may stand for the set, sorted: itself, what links(curie, other) lead to, and
    the families(family, member) whose members are all among them.

    Equal sets are worked out once.
    """
    sets = golds.select("curies").distinct().withColumn("hay", F.md5(F.to_json("curies")))
    own = sets.select("hay", F.explode("curies").alias("curie")).distinct()
    other = [own.hint("merge").join(link.select("curie", "other").distinct(), "curie").select("hay", F.col("other").alias("curie")) for link in links]
    wide = reduce(DataFrame.unionByName, other, own).distinct()
    if families is not None:
        within = contained_sets(families.select(F.col("family").alias("needle"), F.col("member").alias("item")), wide.select("hay", F.col("curie").alias("item")))
        wide = wide.unionByName(within.select("hay", F.concat(F.lit(f"{prefix}:"), "needle").alias("curie")))
    listed = wide.groupBy("hay").agg(F.sort_array(F.collect_set("curie")).alias("synonyms"))
    return sets.hint("merge").join(listed, "hay", "left").select("curies", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"))


def tree_ancestors(number: str | Column) -> Column:
    """A tree number and those above it, up to its letter: 'D12.776.157' -> D, D12, D12.776, D12.776.157."""
    c = F.col(number) if isinstance(number, str) else number
    parts = F.split(c, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    return F.array_distinct(F.concat(F.array(F.substr(c, F.lit(1), F.lit(1))), above))


def classes_by_descent(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes(id, tree_number), roots(class, tree_number) -> id, class of all nodes at or below a root, without a closure.

    A number's ancestors are its own beginnings, a dozen at most, so descent is an equality join with the roots.
    """
    above = nodes.filter("tree_number is not null and tree_number <> ''").select("id", F.explode(tree_ancestors("tree_number")).alias("tree_number"))
    return above.join(roots.select("class", "tree_number").distinct(), "tree_number").select("id", "class").distinct()
