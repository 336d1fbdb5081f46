"""N-gram Jaccard join by vertical partitioning, and the classes of texts that it links.

A document's set holds its distinct shingles of k consecutive words (fewer words: the whole sequence as one).
Two documents link when 100 * intersection >= threshold * union.

1. Documents with equal sets are one class; its smallest doc_id represents it.
2. Screen: a linked set shares at least threshold percent of its shingles. Linked sets x and y even share a number of
   the first shingles of both in hash order (long_prefix(), shared_least()), so these are dealt to buckets by hash, and
   each bucket counts which of them two sets have. A set with too few of those has no link and goes no further.
   What a task knows to be shared is counted there and sends one entry a shingle, however many of its sets have it.
3. Global order of the remaining sets' shingles: rare ones first, by the level (binary logarithm) of the number of sets
   that have them, then by hash. Shingles of one set need no place in it. The order is cut into FRAGMENTS ranges.
4. Linked sets share a shingle in their prefixes in that order. The holders of each prefix shingle are compared with one
   of them, the head: a row for each holder, not for each pair. The head is the holder that has least of its own: of a
   group of edited copies the one with which the others link if they link with any. Segments are compared fragment by
   fragment; partial overlaps are counted separately and summed per pair.
5. Holders are then known by what tells them from the centre, the head's shared tokens: x = centre xor dx, so the symmetric
   difference of x and y is that of dx and dy. Sets near enough to the centre link with the nearest one for sure. If
   x is not, a link of x and y needs dx and dy to share shingles (differing()), so they meet in prefixes of dx and dy, and
   only pairs of different components that do are compared. So no link is lost, and no pairs of a group are listed.

Components of the links are found by alternating large-star and small-star steps over tables in the shared folder.

Shingles are told apart by 64-bit hashes and classes by two of them. Defined cases: a null, empty or blank text has an
empty set, links with nothing and is its own component; rows with a null doc_id are returned with a null component_id
and link with nothing; rows with one doc_id are one node with the sets of all of them; an empty table gives no rows;
columns other than doc_id and text are not read. Nothing is capped or sampled.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, joined, mix, settle, small_batches, spans, word_hashes

#: Levels of rarity, and ranges of the global order: each level is cut in two by hash.
LEVELS = 8
FRAGMENTS = 2 * LEVELS
#: The screen's entries: so many in a bucket on average, and so many in a task before they are sent.
BUCKET_ENTRIES = 700_000
SEND_ENTRIES = 1_000_000
#: ASCII white space separates words.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    raw = [t.encode("utf-8", "surrogatepass").lower() if isinstance(t, str) else b"" for t in texts]  # bytes.lower: A-Z only
    data, begin = joined(raw)
    starts, ends = spans(~_SPACE[data])
    words = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, begin)
    whole = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        whole += words[j : j + len(whole)] * _STEP[j]
    whole = mix(whole)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            s = np.sort(whole[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif b > a:
            out.append(mix((words[a:b] * _STEP[: b - a]).sum(keepdims=True) + _STEP[32:33] * np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprints(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set, as signed integers."""
    a = np.array([s.sum(dtype=np.uint64), mix(s ^ _STEP[40]).sum(dtype=np.uint64)], np.uint64)
    a = mix(a + _STEP[41:43] * np.uint64(len(s))).view(np.int64)
    return int(a[0]) or 1, int(a[1])  # 0 is no set's


# ---- how many shingles linked sets share: the same integers in Python and SQL ------------------


def overlap_least(n: int, threshold: int) -> int:
    """A set of n shingles shares so many with each set that it links with."""
    return -(-threshold * n // 100)


def extra(n: int, threshold: int) -> int:
    return min(n * (100 - threshold) // 200, overlap_least(n, threshold) - 1)


def long_prefix(n: int, threshold: int) -> int:
    """Sets that link share extra() + 1 of the smaller one's in such prefixes of both, in any order of all shingles."""
    return n - overlap_least(n, threshold) + 1 + extra(n, threshold)


def shared_least(threshold: int):
    """The least extra() + 1 of the sets that a set of n can link with: the smallest has overlap_least(n)."""
    least = f"(({threshold} * n + 99) div 100)"
    return F.expr(f"1 + least({least} * {100 - threshold} div 200, ({threshold} * {least} + 99) div 100 - 1)")


def prefix(threshold: int):
    """Of a set in the global order, of which single shingles come first and are left out: the rest of its prefix."""
    return F.expr(f"slice(tokens, 1, greatest(0, size(tokens) - ({threshold} * n + 99) div 100 + 1))")


# ---- tasks -------------------------------------------------------------------------------------


def _features(k: int):
    def run(batches):
        for pdf in chunks(batches):
            sets = shingle_sets(list(pdf["text"]), k)
            prints = [fingerprints(s) for s in sets]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": [len(s) for s in sets], "fa": [p[0] for p in prints], "fb": [p[1] for p in prints]})

    return run


def _distinct(batches, k: int):
    """fa and set of each text whose set is new in this task."""
    seen = set()
    for pdf in chunks(batches):
        for s in shingle_sets(list(pdf["text"]), k):
            if len(s) and (fa := fingerprints(s)[0]) not in seen:
                seen.add(fa)
                yield fa, s


def _ends(x: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values of a sorted array."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)


def _tally(owner: np.ndarray) -> tuple[bytes, bytes]:
    fa, count = np.unique(owner, return_counts=True)
    return fa.astype("<i8").tobytes(), count.astype("<i4").tobytes()


#: Stands for the owners of a shingle that is known to be shared.
SEVERAL = 0


def _dealt(k: int, threshold: int, buckets: int):
    """The long prefixes, dealt to buckets: tokens, and the place of each one's owner in fa. Counts: of those known to be shared."""

    def pack(parts):
        token = mix(np.concatenate([s for _, s in parts]))  # prefixes hold small hashes: mixed, so that they spread evenly over buckets
        owner = np.repeat(np.array([fa for fa, _ in parts], np.int64), [len(s) for _, s in parts])
        order = np.argsort(token)
        token, owner = token[order], owner[order]
        ends = _ends(token)
        several = np.repeat(np.diff(ends) > 1, np.diff(ends))
        fa, count = _tally(owner[several])
        rows = [(int(token[0] % np.uint64(buckets)), b"", b"", fa, count)]
        keep = ~several
        keep[ends[:-1]] = True
        token, owner = token[keep], np.where(several, SEVERAL, owner)[keep]
        bucket = ((token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        ends = _ends(bucket)
        for a, z in zip(ends[:-1], ends[1:], strict=True):
            fa, place = np.unique(owner[a:z], return_inverse=True)
            rows.append((int(bucket[a]), token[a:z].astype("<u8").tobytes(), place.astype("<u4").tobytes(), fa.astype("<i8").tobytes(), b""))
        for k in range(0, len(rows), 20):  # in small batches, for the memory of both sides
            yield pd.DataFrame(rows[k : k + 20], columns=["bucket", "token", "place", "fa", "count"])

    def run(batches):
        parts, size = [], 0
        for fa, s in _distinct(batches, k):
            parts.append((fa, s[: long_prefix(len(s), threshold)]))
            size += len(parts[-1][1])
            if size > SEND_ENTRIES:
                yield from pack(parts)
                parts, size = [], 0
        if parts:
            yield from pack(parts)

    return run


def _shared(groups: int):
    """A bucket's entries -> group, fa, count: how many of the set's tokens there another one has too, packed by groups of sets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        token, owner, sure, count = [], [], [], []
        for t, p, fa, c in zip(pdf["token"], pdf["place"], pdf["fa"], pdf["count"], strict=True):
            fa = np.frombuffer(fa, "<i8")
            if len(c):
                sure.append(fa)
                count.append(np.frombuffer(c, "<i4"))
            elif len(t):
                token.append(np.frombuffer(t, "<u8"))
                owner.append(fa[np.frombuffer(p, "<u4")])
        if token:
            token, owner = np.concatenate(token), np.concatenate(owner)
            order = np.argsort(token)
            token, owner = token[order], owner[order]
            ends = _ends(token)
            shared = np.minimum.reduceat(owner, ends[:-1]) < np.maximum.reduceat(owner, ends[:-1])
            owner = owner[np.repeat(shared, np.diff(ends))]
            fa, c = np.unique(owner[owner != SEVERAL], return_counts=True)
            sure.append(fa)
            count.append(c.astype(np.int32))
        fa, c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sure, count))
        group = ((mix(fa.astype(np.int64).view(np.uint64)) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        group, fa, c = group[order], fa[order], c[order]
        ends = _ends(group)
        rows = [(int(group[i]), fa[i:z].astype("<i8").tobytes(), c[i:z].astype("<i4").tobytes()) for i, z in zip(ends[:-1], ends[1:], strict=True)]
        return pd.DataFrame(rows, columns=["group", "fa", "count"])

    return run


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    fa, c = np.frombuffer(b"".join(pdf["fa"]), "<i8"), np.frombuffer(b"".join(pdf["count"]), "<i4")
    fa, place = np.unique(fa, return_inverse=True)
    return pd.DataFrame({"fa": fa, "c": np.bincount(place, c, len(fa)).astype(np.int64)})


def _sets(k: int):
    def run(batches):
        distinct = _distinct(batches, k)
        while rows := list(itertools.islice(distinct, 100)):
            yield pd.DataFrame({"fa": [fa for fa, _ in rows], "n": [len(s) for _, s in rows], "tokens": [s.view(np.int64) for _, s in rows]})

    return run


def _segments(batches):
    for pdf in batches:
        rows = []
        for fa, tokens, levels in zip(pdf["fa"], pdf["tokens"], pdf["levels"], strict=True):
            tokens = np.asarray(tokens, np.int64)
            fragment = 2 * np.asarray(levels, np.int64) + (tokens >= 0)
            cut = np.searchsorted(fragment, np.arange(FRAGMENTS + 1))
            rows += [(fa, j, tokens[cut[j] : cut[j + 1]]) for j in range(FRAGMENTS)]
        yield pd.DataFrame(rows, columns=["doc", "fragment", "tokens"])


# ---- the join ----------------------------------------------------------------------------------


def fragments_of(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """pairs(a, b) -> a, b, fragment, ta, tb."""
    one = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    # by key at any size: Spark takes exploded pairs for smaller than they are and would broadcast them
    one = one.hint("merge").join(segments.select(F.col("doc").alias("a"), "fragment", F.col("tokens").alias("ta")), ["a", "fragment"])
    return one.hint("merge").join(segments.select(F.col("doc").alias("b"), "fragment", F.col("tokens").alias("tb")), ["b", "fragment"])


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """pairs(a, b) -> a, b, common: partial overlaps of each fragment, summed."""
    part = fragments_of(pairs, segments).select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("common"))
    return part.groupBy("a", "b").agg(F.sum("common").alias("common"))


def differences(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """pairs(a, b) -> a, b, diff: the tokens that only one of the two has, in the global order."""
    d = F.array_sort(F.concat(F.array_except("ta", "tb"), F.array_except("tb", "ta")))
    part = fragments_of(pairs, segments).select("a", "b", F.struct("fragment", d.alias("d")).alias("part"))
    parts = part.groupBy("a", "b").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return parts.select("a", "b", F.flatten("parts.d").alias("diff"))


def differing(diff: DataFrame, threshold: int) -> DataFrame:
    """head, x, y of different components that may link, x not near.

    diff(head, doc, n, d, diff, far, least_far, near, component): d is the distance of the set from the head's shared tokens,
    diff what others can share of the difference, far = (100 + threshold) * d - (100 - threshold) * n. A link needs
    far(x) + far(y) <= 2 * (100 + threshold) * common, and common >= d - n * (100 - threshold) / threshold of both. Near are
    those with far + least_far <= 0; so if x is not, common is at least 1 and more than (far(y) - least_far) / (2 * (100 + threshold)).
    Differences with that much in common meet in their prefixes.
    """
    twice, v = 2 * (100 + threshold), (100 - threshold) / threshold
    single = F.col("d") - F.size("diff")  # come first in the order and are shared with none
    least = F.greatest(F.lit(1), F.ceil(F.col("d") - v * F.col("n") - 1e-6))
    of_x = F.greatest(least, F.ceil((F.col("far") + F.col("least_far")) / twice - 1e-6))
    of_y = F.greatest(least, F.floor((F.col("far") - F.col("least_far")) / twice - 1e-6) + 1)
    upto = lambda common: F.greatest(F.lit(0), F.col("d") - common + 1 - single).cast("int")
    both = diff.withColumn("short", upto(of_y))
    as_x = both.filter("not near").select("head", F.col("doc").alias("x"), F.col("component").alias("cx"), "short", F.posexplode(F.slice("diff", F.lit(1), upto(of_x))).alias("at", "token"))
    as_y = both.select("head", F.col("doc").alias("y"), F.col("component").alias("cy"), "near", F.explode(F.slice("diff", F.lit(1), F.col("short"))).alias("token"))
    met = as_x.join(as_y, ["head", "token"]).filter((F.col("cx") != F.col("cy")) & (F.col("near") | (F.col("at") < F.col("short"))))
    return met.select("head", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, component (the smallest node that is reachable). Nodes without edges are left out."""
    now = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
        # large star: every larger neighbour goes to the smallest one
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: every smaller neighbour and the node itself go to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        new = settle(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(now)
        now = new
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def screened(docs: DataFrame, classes: DataFrame, k: int, threshold: int) -> DataFrame:
    """The classes (rep, fa, n) that share enough with others to have a link."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, int(total * long_prefix(1000, threshold) / 1000) // BUCKET_ENTRIES + 1)
    dealt = docs.mapInPandas(_dealt(k, threshold, buckets), "bucket int, token binary, place binary, fa binary, count binary")
    counts = dealt.groupBy("bucket").applyInPandas(_shared(buckets), "group int, fa binary, count binary")
    counts = counts.groupBy("group").applyInPandas(_summed, "fa long, c long")
    return settle(counts.join(classes, "fa").filter(F.col("c") >= shared_least(threshold)).select("rep", "fa", "n"), "screened")


def ordered_sets(docs: DataFrame, classes: DataFrame, k: int, threshold: int) -> DataFrame:
    """The screened classes with their shared tokens in the global order: fa, n, tokens, levels."""
    # dealt by doc_id at any size: what is left after the screen grows with the documents, so it is never broadcast
    own = docs.hint("merge").join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    own = own.mapInPandas(_sets(k), "fa long, n int, tokens array<long>")
    sets = settle(own.groupBy("fa").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")), "sets")
    often = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("f")).filter("f > 1")
    often = often.select("token", F.least(F.floor(F.log2("f")) - 1, F.lit(LEVELS - 1)).cast("byte").alias("level"))
    shared = sets.select("fa", "n", F.explode("tokens").alias("token")).join(often, "token")
    order = shared.groupBy("fa").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("level", "token"))).alias("o"))
    order = order.filter(100 * F.size("o") >= threshold * F.col("n"))
    out = settle(order.select("fa", "n", F.col("o.token").alias("tokens"), F.col("o.level").alias("levels")), "ordered")
    discard(sets)
    return out


def ngram_links(docs: DataFrame, k: int = 5, threshold: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs(doc_id, text) -> features (doc_id, n), doc_id with rep, components of representatives (node, component).

    Links between different texts are joined to components; equal sets share a representative.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = settle(docs.mapInPandas(_features(k), "doc_id long, n int, fa long, fb long"), "features")
    usable = features.filter("n > 0 and doc_id is not null")
    classes = settle(usable.groupBy("fa", "fb", "n").agg(F.min("doc_id").alias("rep")), "classes")
    docs = docs.filter("doc_id is not null")
    alive = screened(docs, classes.drop("fb"), k, threshold)
    sets = ordered_sets(docs, alive, k, threshold)

    # every holder of a prefix token meets the head of that token
    own = (F.col("n") - F.size("tokens")) / F.col("n")
    prefixes = sets.select("fa", own.alias("own"), F.explode(prefix(threshold)).alias("token"))
    heads = prefixes.groupBy("token").agg(F.min(F.struct("own", "fa")).alias("m"), F.count("*").alias("f")).filter("f > 1")
    met = prefixes.join(heads.select("token", F.col("m.fa").alias("head")), "token").filter("fa <> head")
    met = settle(met.select(F.col("head").alias("a"), F.col("fa").alias("b")).distinct(), "met")
    segments = settle(sets.select("fa", "tokens", "levels").mapInPandas(_segments, "doc long, fragment int, tokens array<long>"), "segments")
    known = alive.groupBy("fa").agg(F.min("rep").alias("rep")).join(sets.select("fa", "n", F.size("tokens").alias("shared")), "fa")
    side = lambda x: known.select(F.col("fa").alias(x), F.col("n").alias(f"n{x}"), F.col("rep").alias(f"rep_{x}"), F.col("shared").alias(f"shared_{x}"))
    far = lambda d, n: (100 + threshold) * F.col(d) - (100 - threshold) * F.col(n)
    held = overlaps(met, segments).join(side("a"), "a").join(side("b"), "b")
    held = held.withColumn("linked", 100 * F.col("common") >= threshold * (F.col("na") + F.col("nb") - F.col("common")))
    held = held.withColumn("d", F.col("nb") + F.col("shared_a") - 2 * F.col("common")).withColumn("d_head", F.col("na") - F.col("shared_a"))
    held = settle(held.withColumn("far", far("d", "nb")).withColumn("far_head", far("d_head", "na")), "held")
    # two sets link for sure if the sum of far is not positive: with the one that has the least of all, if with any
    least = held.groupBy("a").agg(F.min(F.struct("far", F.col("rep_b").alias("rep"))).alias("m"), F.min(F.struct(F.col("far_head").alias("far"), F.col("rep_a").alias("rep"))).alias("h"))
    least = least.select("a", F.least("m", "h").alias("m")).select("a", F.col("m.far").alias("least_far"), F.col("m.rep").alias("centre"))
    held_too = settle(held.join(least, "a").withColumn("near", F.col("far") + F.col("least_far") <= 0), "held")
    discard(held)
    held = held_too

    # rows with one doc_id are one node
    several = usable.join(classes, ["fa", "fb", "n"]).select("doc_id", "rep")
    one = several.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b")
    one = one.join(several, "doc_id").select("a", F.col("rep").alias("b"))
    links = held.filter("linked").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).unionByName(one)
    links = links.unionByName(held.filter("near").select(F.col("centre").alias("a"), F.col("rep_b").alias("b")))
    links = settle(links.unionByName(held.filter("far_head + least_far <= 0").select(F.col("centre").alias("a"), F.col("rep_a").alias("b"))).filter("a <> b").distinct(), "links")
    found = settle(components(links), "components")

    # holders of one head in several components, of which one is not near
    named = held.join(found.select(F.col("node").alias("rep_b"), "component"), "rep_b", "left").withColumn("component", F.coalesce("component", "rep_b"))
    apart = named.groupBy("a").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min("near").alias("all")).filter("least < most and not all")
    named = named.select(F.col("a").alias("head"), F.col("b").alias("doc"), F.col("nb").alias("n"), F.col("rep_b").alias("rep"), "d", "far", "least_far", "near", "component")
    named = settle(named.join(apart.select(F.col("a").alias("head")), "head", "left_semi"), "apart")
    pairs = named.select(F.col("head").alias("a"), F.col("doc").alias("b"))
    diff = differences(pairs, segments).select(F.col("a").alias("head"), F.col("b").alias("doc"), "diff")
    diff = settle(named.join(diff, ["head", "doc"]), "differences")
    rest = settle(differing(diff, threshold), "rest")
    side = lambda x: diff.select("head", F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("d").alias(f"d{x}"), F.col("diff").alias(f"diff_{x}"), F.col("rep").alias(f"rep_{x}"))
    rest = rest.join(side("x"), ["head", "x"]).join(side("y"), ["head", "y"])
    gap = F.col("dx") + F.col("dy") - 2 * F.size(F.array_intersect("diff_x", "diff_y"))
    more = rest.filter((100 + threshold) * gap <= (100 - threshold) * (F.col("nx") + F.col("ny"))).select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b"))
    found = settle(components(links.unionByName(more)), "components")
    reps = settle(several.distinct(), "representatives")
    discard(classes, alive, sets, met, segments, held, links, named, diff)
    return features.select("doc_id", "n"), reps, found


def ngram_components(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, one row a document row."""
    features, reps, found = ngram_links(docs, k, threshold)
    named = reps.join(found, reps["rep"] == found["node"], "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = features.join(named, "doc_id", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


ORACLE_TEMPLATE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= {t} * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= {t} * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, m.c AS component_id FROM s JOIN (SELECT node, min(seen) AS c FROM r GROUP BY node) m ON m.node = s.doc_id
"""
ORACLE = ORACLE_TEMPLATE.format(k=4, t=85)


def keep_first(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """The documents (all columns) without those whose component has a smaller doc_id.

    Rows with a null doc_id and rows that share the kept doc_id stay.
    """
    later = ngram_components(docs, k, threshold).filter("component_id <> doc_id").select(F.col("doc_id").alias("later")).distinct()
    return docs.join(later, docs["doc_id"].cast("long") == later["later"], "left_anti")
