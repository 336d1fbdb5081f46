"""Prefix trie of conversations by smallest-member ownership.

Each conversation is a path from the textless root; conversations that begin alike share nodes. A node belongs to its
smallest member. That member stays the smallest one further down its path, so what a conversation owns is a suffix of its
path, told by one number: the depth at which it begins. Sums over a subtree are sums over members then: each member adds
its tokens from the node's depth on, less those of the nodes that it owns, and one if it ends in a childless node it owns.
One group-by of the prefixes gives everything, with partial sums before the shuffle, so that the root, which all
conversations share, is no hot task; no path is walked and no subtree is gathered.

A prefix is a 128-bit key: the exclusive or, over its turns, of a digest of (place, role, text). As an exclusive or it is
a running aggregate, worked out by blocks of a conversation, so that one conversation may hold all turns. Turns are
numbered by ranges for the same reason. Texts are read once, for digests and lengths, and are never shuffled.

The members that end at a node are hashed in order of their ids, which is sequential by the nature of the digest: ids are
dealt by ranges, put together in rows of CHUNK characters, and a node's rows stream through one digest, one at a time.

Defined cases: rows without a conv_id are left out; a null turn comes first; rows of equal turn are put in order of a
digest of role and text; repeated rows are turns of their own; null role and text are empty ones; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_sql, numbered, settle

#: Running sums are worked out by blocks of so many turns; ids are put together in rows of so many characters.
BLOCK, CHUNK = 4096, 1 << 16
#: The last conversation of a hundred begins like their first one: at most SHARED - 1 turns are taken over.
SHARED = 6


def turns(table: DataFrame) -> DataFrame:
    """conv_id, place (from 0), n (turns of the conversation), a, b (digest of role and text), len (code points of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    both = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    half = lambda k: F.conv(F.substr(both, F.lit(k), F.lit(15)), 16, 10).cast("long")
    rows = table.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", half(1).alias("a"), half(16).alias("b"), F.char_length(text).cast("long").alias("len"))
    placed = numbered(settle(rows, "trie-turns"), "conv_id", "turn", "a", "b", name="trie-placed")
    return settle(placed.select("conv_id", F.col("idx").alias("place"), "n", "a", "b", "len"), "trie-numbered")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, depth; turns: conv_id, place from 1, a, b, len) after each has taken over its base's first turns."""
    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    convs = placed.groupBy("conv_id").agg(F.first("n").alias("n")).withColumn("h", own).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = settle(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth")), "trie-convs")
    # a base's turns meet a hundred conversations at most
    first = placed.filter(F.col("place") < SHARED - 1).select(F.col("conv_id").alias("base"), "place", "a", "b", "len")
    head = convs.filter("taken > 0").hint("merge").join(first, "base").filter("place < taken").select("conv_id", (F.col("place") + 1).alias("place"), "a", "b", "len")
    rest = placed.hint("merge").join(convs.select("conv_id", "h", "taken"), "conv_id").filter("place >= h")
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("place"), "a", "b", "len")
    return convs.select("conv_id", "depth"), head.unionByName(rest)


def occurrences(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, depth, end (the conversation's depth), before (tokens above this node), tokens (of the whole), ka, kb (the prefix),
    pa, pb (its parent's): one row a conversation and node of its path, the root included."""
    keyed = rows.select("conv_id", F.col("place").alias("depth"), "len", F.xxhash64("place", "a", "b").alias("x"), F.xxhash64("b", "place", F.lit("second"), "a").alias("y"))
    keyed = settle(keyed.withColumn("block", F.floor(F.col("depth") / BLOCK)), "trie-keyed")
    blocks = keyed.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("len").alias("len"))
    past = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("conv_id")
    zero = F.lit(0).cast("long")
    over = lambda f, w: F.coalesce(f.over(w), zero)
    blocks = blocks.select("conv_id", "block", over(F.bit_xor("x"), past).alias("x0"), over(F.bit_xor("y"), past).alias("y0"), over(F.sum("len"), past).alias("len0"), F.sum("len").over(all_).alias("tokens"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth")
    upto, above = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    runs = keyed.select("conv_id", "block", "depth", F.bit_xor("x").over(upto).alias("x"), F.bit_xor("y").over(upto).alias("y"), over(F.bit_xor("x"), above).alias("px"), over(F.bit_xor("y"), above).alias("py"), over(F.sum("len"), above).alias("len"))
    paths = runs.join(blocks, ["conv_id", "block"]).select(
        "conv_id", "depth", (F.col("len0") + F.col("len")).alias("before"), "tokens", F.col("x").bitwiseXOR(F.col("x0")).alias("ka"), F.col("y").bitwiseXOR(F.col("y0")).alias("kb"),
        F.col("px").bitwiseXOR(F.col("x0")).alias("pa"), F.col("py").bitwiseXOR(F.col("y0")).alias("pb"),
    )
    ends = convs.select("conv_id", F.col("depth").alias("end"))
    sums = blocks.groupBy("conv_id").agg(F.first("tokens").alias("tokens"))
    roots = ends.join(sums, "conv_id", "left").select("conv_id", F.lit(0).cast("long").alias("depth"), zero.alias("before"), F.coalesce("tokens", zero).alias("tokens"), *[zero.alias(k) for k in ("ka", "kb", "pa", "pb")], "end")
    return settle(paths.hint("merge").join(ends, "conv_id").unionByName(roots), "trie-occurrences")


def ended(occ: DataFrame) -> DataFrame:
    """ka, kb, depth, ends_sha256 of the nodes at which a conversation ends: its members' ids, ascending, comma-joined, hashed."""
    node = ["ka", "kb", "depth"]
    ids = occ.filter("depth = end").select(*node, "conv_id").repartitionByRange(*node, "conv_id").sortWithinPartitions(*node, "conv_id")

    def joined(batches):
        """Rows in order -> a row for about CHUNK characters of a node's ids, with the first of them."""
        at, first, parts, size = None, None, [], 0
        for pdf in batches:
            out = []
            for key, c in zip(zip(pdf["ka"].tolist(), pdf["kb"].tolist(), pdf["depth"].tolist(), strict=True), pdf["conv_id"].tolist(), strict=True):
                if key != at or size >= CHUNK:
                    if parts:
                        out.append((*at, first, ",".join(parts)))
                    at, first, parts, size = key, c, [], 0
                parts.append(str(c))
                size += len(parts[-1]) + 1
            yield pd.DataFrame(out, columns=[*node, "first", "ids"])
        if parts:
            yield pd.DataFrame([(*at, first, ",".join(parts))], columns=[*node, "first", "ids"])

    chunks = ids.mapInPandas(joined, "ka long, kb long, depth long, first long, ids string").repartition(*node).sortWithinPartitions(*node, "first")

    def hashed(batches):
        """A node's rows follow each other: one running digest, whatever their number."""
        at, running = None, None
        for pdf in batches:
            out = []
            for key, text in zip(zip(pdf["ka"].tolist(), pdf["kb"].tolist(), pdf["depth"].tolist(), strict=True), pdf["ids"], strict=True):
                if key != at:
                    if running:
                        out.append((*at, running.hexdigest()))
                    at, running = key, hashlib.sha256(text.encode())
                else:
                    running.update(b"," + text.encode())
            yield pd.DataFrame(out, columns=[*node, "ends_sha256"])
        if running:
            yield pd.DataFrame([(*at, running.hexdigest())], columns=[*node, "ends_sha256"])

    return chunks.mapInPandas(hashed, "ka long, kb long, depth long, ends_sha256 string")


def trie(table: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, rows = rebuilt(turns(table))
    occ, node = occurrences(convs, rows), ["ka", "kb", "depth"]
    # the owner of each node, and whether nobody goes on behind it
    owners = occ.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.max("end").alias("deepest")).withColumn("childless", F.col("deepest") == F.col("depth"))
    owned = owners.groupBy("conv_id").agg(F.min("depth").alias("own"), F.max("childless").cast("long").alias("leaf"))
    members = occ.hint("merge").join(owned, "conv_id", "left")
    # a window over a conversation's blocks is not needed: `before` at the first owned node says what lies above it
    top = occ.hint("merge").join(owned.select("conv_id", F.col("own").alias("depth")), ["conv_id", "depth"])
    top = settle(top.select("conv_id", F.col("before").alias("own_before"), F.col("depth").alias("own"), "pa", "pb"), "trie-tops")
    members = members.join(top.select("conv_id", "own_before"), "conv_id", "left")
    mark = F.col("own").isNotNull()
    mine = F.when(mark, F.col("tokens") - F.greatest("before", "own_before")).otherwise(0)
    rows = members.select(*node, "conv_id", (F.col("tokens") - F.col("before") - mine).alias("saved"), F.when(mark & (F.col("end") > F.col("depth")) & (F.col("own") <= F.col("depth") + 1), 1).otherwise(0).alias("child"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    nodes = rows.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    nodes = settle(nodes.join(ended(occ), node, "left"), "trie-nodes")
    # below the top of what a conversation owns, parents are its own; the tops' parents are other conversations' nodes
    up = nodes.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), (F.col("depth") + 1).alias("own"), F.col("conv_id").alias("parent"))
    above = settle(top.filter("own > 0").hint("merge").join(up, ["pa", "pb", "own"]).select("conv_id", F.col("own").alias("depth"), "parent"), "trie-parents")
    out = nodes.hint("merge").join(above, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


ORACLE = f"""WITH q AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, sha256(strlen(role)::VARCHAR || ':' || role || text)) AS ts FROM q GROUP BY conv_id),
h AS (SELECT *, conv_id - conv_id % 100 AS base, ({crc32_sql('conv_id::VARCHAR')} % 6)::INT AS h FROM o),
b AS (SELECT h.conv_id, list_concat(coalesce(x.ts, [])[:h.h], h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN o x ON x.conv_id = h.base),
p AS (SELECT conv_id, len(ts) AS stop, unnest(range(0, len(ts) + 1)) AS depth, ts FROM b),
n AS (SELECT depth, ts[:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (stop = depth), '') AS ends FROM p GROUP BY ALL),
c AS (SELECT n.*, coalesce(k.n, 0) AS n_children, u.conv_id AS parent FROM n LEFT JOIN (SELECT path[:depth - 1] AS path, depth - 1 AS depth, count(*) AS n FROM n WHERE depth > 0 GROUP BY ALL) k USING (path, depth)
    LEFT JOIN n u ON u.depth = n.depth - 1 AND u.path = n.path[:n.depth - 1]),
d AS (SELECT path, depth, n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * len(path[depth].t) ELSE 0 END AS cost, unnest(range(0, depth + 1)) AS up FROM c),
s AS (SELECT path[:up] AS path, up AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(cost) AS saved FROM d GROUP BY ALL)
SELECT c.conv_id::BIGINT AS conv_id, c.depth::BIGINT AS depth, c.parent::BIGINT AS parent_conv_id, c.n_convs::BIGINT AS n_convs, c.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(c.ends) AS ends_sha256 FROM c JOIN s USING (path, depth)"""
