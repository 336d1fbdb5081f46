"""Merkle manifest of a data set: parent-preimage paths.

A leaf is the digest of a row's fields; each group's leaves, in order, are hashed by runs of FAN until one node, the
group's subroot, is left, and the subroots likewise until one root is left. What is stored a parent is its preimage, the
concatenated digests of its children. A leaf's path is the preimages of its ancestors with the slot that the path takes in
each: siblings are what is left of a preimage once the own 64 characters are excised, and a fold splices the digest that
was reached so far into that slot and hashes again.

Levels are made two at a time, and paths handed down from the root likewise, two levels a join on (group, ancestor): an
ancestor meets FAN * FAN descendants at most, so that the root's preimage is not a hot key. Leaves are numbered by ranges, so
that a group may hold all rows. Texts are read once, for the leaves; all else works on digests, and the number of levels is
the logarithm of the largest group.

Defined cases: a null field is written `-`, an empty one `0:`; rows with a null group form one group, before all others;
rows of equal order are put in order of their digests, so that repeated rows are leaves of their own; a null id comes first
and is never tampered with; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, kept, numbered, settle

FAN, DIGEST = 8, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def written(value: Column) -> Column:
    """A field of a leaf: `-` for null, otherwise its bytes' number, a colon, the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(written, values)).cast("binary"), 256)


def parents(nodes: DataFrame) -> DataFrame:
    """nodes(group, idx, hash, n) of groups with more than one -> the nodes two levels up: group, idx, low, preimage, hash, n.

    low: the preimages of the level between. preimage: null where that level is the group's last; hash is its node's then.
    """
    runs = nodes.filter("n > 1").groupBy("group", F.floor(F.col("idx") / FAN**2).alias("idx"))
    rows = runs.agg(F.array_sort(F.collect_list(F.struct((F.col("idx") % FAN**2).alias("slot"), "hash"))).alias("run"), F.first("n").alias("n"))
    rows = rows.select("group", "idx", F.transform("run", lambda x: x["hash"]).alias("run"), F.ceil(F.col("n") / FAN).alias("n"))
    starts = F.sequence(F.lit(1), F.size("run"), F.lit(FAN))
    rows = rows.withColumn("low", F.transform(starts, lambda at: F.array_join(F.slice("run", at, FAN), ""))).drop("run")
    above = F.array_join(F.transform("low", lambda p: F.sha2(p.cast("binary"), 256)), "")
    rows = rows.select("group", "idx", "low", F.when(F.col("n") > 1, above).alias("preimage"), F.ceil(F.col("n") / FAN).alias("n"))
    return rows.withColumn("hash", F.sha2(F.coalesce("preimage", F.get("low", F.lit(0))).cast("binary"), 256))


def levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The nodes and each second level above them, each written; the last has tops only."""
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(settle(parents(out[-1]), f"{name}-level{len(out)}"))
        most = -(-most // FAN**2)
    return out


def handed_down(tree: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The columns of tree[0], and above, path: those of its group's top (tops: group, above, path) below its own levels'.

    path is an array of (preimage, slot), the nearest ancestor first. above is any column that belongs to a group.
    """
    extra = [c for c in tops.columns if c not in ("group", "path")]
    rows = tree[-1].filter("n <= 1").join(tops, "group")
    slot = lambda idx: (idx % FAN).cast("int")
    step = lambda preimage, idx: F.array(F.struct(preimage.alias("preimage"), slot(idx).alias("slot")))
    for nodes in tree[-2::-1]:
        above = rows.select("group", F.col("idx").alias("_up"), F.col("low").alias("_low"), F.col("preimage").alias("_preimage"), F.col("path").alias("_path"), *extra)
        between = F.floor(F.col("idx") / FAN)
        inner = nodes.filter("n > 1").withColumn("_up", F.floor(F.col("idx") / FAN**2)).hint("merge").join(above, ["group", "_up"])
        near = step(F.get("_low", slot(between)), F.col("idx"))
        path = F.when(F.col("_preimage").isNull(), F.concat(near, "_path")).otherwise(F.concat(near, step(F.col("_preimage"), between), "_path"))
        inner = inner.withColumn("path", path).drop("_up", "_low", "_preimage", "_path")
        rows = nodes.filter("n <= 1").join(tops, "group").unionByName(inner)
    return rows


def siblings(path) -> Column:
    """The other digests of each run of a path, from the leaf's level to the root's, left to right, concatenated."""
    cut = lambda p: F.concat(F.substr(p["preimage"], F.lit(1), p["slot"] * DIGEST), F.substr(p["preimage"], (p["slot"] + 1) * DIGEST + 1))
    return F.array_join(F.transform(path, cut), "")


def folded(leaf: Column, path) -> Column:
    """The root that a leaf and its path give: the digest is spliced into its slot, level by level."""
    spliced = lambda at, p: F.concat(F.substr(p["preimage"], F.lit(1), p["slot"] * DIGEST), at, F.substr(p["preimage"], (p["slot"] + 1) * DIGEST + 1))
    return F.aggregate(path, leaf, lambda at, p: F.sha2(spliced(at, p).cast("binary"), 256))


def manifest(rows: DataFrame, id_: str = "doc_id") -> DataFrame:
    """rows(id_, group, leaf, ..) of any slim further columns -> with subroot, root, path.

    rows have to be kept ones (kept or settle), for they are read several times.
    """
    leaves = numbered(rows, "group", id_, "leaf", name="merkle-leaves", hold=kept).withColumn("hash", F.col("leaf"))
    leaves = kept(leaves, "merkle-nodes")
    tree = levels(leaves, "merkle")
    tops = reduce(DataFrame.unionByName, [t.filter("n <= 1").select("group", "hash") for t in tree])
    # the groups are the leaves of one more tree, whose only group is ''
    forest = numbered(settle(tops.select(F.lit("").alias("group"), F.col("group").alias("name"), "hash"), "merkle-subroots"), "group", "name", name="merkle-groups")
    forest = levels(settle(forest, "merkle-forest"), "merkle-root")
    root = forest[-1].filter("n <= 1").select("group", F.col("hash").alias("root"), F.array().cast("array<struct<preimage:string,slot:int>>").alias("path"))
    subroots = handed_down(forest, root).select(F.col("name").alias("group"), F.col("hash").alias("subroot"), "root", "path")
    return handed_down(tree, settle(subroots, "merkle-tops")).drop("hash", "idx", "n")


def digest(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, where each third document is tampered with."""
    fields = [F.col(c) for c in FIELDS]
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_digest(*fields[:-1], small))
    # '-' sorts before '=': rows without a group come first
    group = F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), "lang"))
    rows = docs.select("doc_id", group.alias("group"), leaf_digest(*fields).alias("leaf"), tampered.alias("tampered"))
    out = manifest(kept(rows, "merkle-rows"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings("path").cast("binary"), 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), "path").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    head = " || ".join(map(field, FIELDS[:-1]))
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    level = """SELECT grp, (idx // 8)::BIGINT AS idx, (n + 7) // 8 AS n, lev + 1 AS lev, sha256(string_agg(hash, '' ORDER BY idx)) AS hash, string_agg(hash, '' ORDER BY idx) AS pre
    FROM {0} WHERE n > 1 GROUP BY grp, idx // 8, n, lev"""
    fold = """SELECT {1}, f.root, f.idx // 8, f.lev + 1, sha256(left(p.pre, (f.idx % 8) * 64) || f.at || substr(p.pre, (f.idx % 8) * 64 + 65)), f.sib || left(p.pre, (f.idx % 8) * 64) || substr(p.pre, (f.idx % 8) * 64 + 65)
    FROM {0} f JOIN {2} p ON {3} p.lev = f.lev + 1 AND p.idx = f.idx // 8"""
    return f"""WITH RECURSIVE l AS (SELECT doc_id, coalesce('=' || lang, '-') AS grp, sha256({head} || {field('text')}) AS leaf,
    CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN sha256({head} || {field(small)}) END AS bad FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM l),
t AS (SELECT grp, idx, n, 0::BIGINT AS lev, leaf AS hash, '' AS pre FROM o UNION ALL {level.format('t')}),
s AS (SELECT grp, hash, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
r AS (SELECT '' AS grp, idx, n, 0::BIGINT AS lev, hash, '' AS pre FROM s UNION ALL {level.format('r')}),
w AS (SELECT hash AS root FROM r WHERE n = 1),
f AS (SELECT grp, doc_id, leaf, idx, 0::BIGINT AS lev, coalesce(bad, leaf) AS at, '' AS sib FROM o UNION ALL
    {fold.format('f', 'f.grp, f.doc_id, f.leaf', 't', 'p.grp = f.grp AND').replace('f.root, ', '')}),
g AS (SELECT grp, max(lev) AS top FROM t GROUP BY grp),
e AS (SELECT f.grp, f.doc_id, f.leaf, s.hash AS root, s.idx, 0::BIGINT AS lev, f.at, f.sib FROM f JOIN g ON g.grp = f.grp AND g.top = f.lev JOIN s ON s.grp = f.grp UNION ALL
    {fold.format('e', 'f.grp, f.doc_id, f.leaf', 'r', '')})
SELECT e.doc_id, e.leaf, e.root AS subroot, w.root, sha256(e.sib) AS proof_sha256, e.at AS folded_root, e.at = w.root AS verified FROM e, w WHERE e.lev = (SELECT max(lev) FROM r)"""


ORACLE = _oracle()
