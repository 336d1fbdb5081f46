"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items are lower-cased and white space runs become one space. A document is contaminated by an item if a
window that starts at one of its words is within allowed(length) edits of the item: EDIT_SHARE of the item's bytes.

The CGK random walk reads a string with a pointer that advances by a random bit of (step, byte); it maps a small
edit distance to a small Hamming distance of the outputs. Item-sized windows are embedded with WALKS walks, and
bands of BAND sampled outputs are looked up among the items' bands; their number reaches TARGET_RECALL for pairs
whose outputs agree in AGREE of the places, the agreement of inserted and deleted bytes at the full limit. Pairs that meet
in a band are verified by an exact edit distance, whose steps follow the distance that is found; pairs that meet in none
are not found. exact=True verifies every screened window instead, so that no pair is lost.

A pair's windows are taken in falling order of the q-grams that they share with the item: the best one first, then those
that could still be as near as what was found.

Windows are screened before they are embedded, without loss: a window within d edits of an item of m bytes shares
at least m - q + 1 - q * d q-grams with it. Windows of all lengths are embedded together.

The items are collected a block at a time, each block of at most BLOCK_BYTES (one larger item is its own block), so
what is broadcast at once does not grow with the benchmark; documents are read once for BLOCKS blocks. Nothing is shuffled but the
result's pairs.

Defined cases: null or empty texts contain nothing; null or blank items and items without an item_id are left out;
rows with a null doc_id are left out; repeated rows and repeated items give the same pairs once; items shorter than
Q bytes are found by exact search at word starts; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import built_once, chunks, mix, small_batches

Q = 12
EDIT_SHARE = 0.06
WALKS, BAND, AGREE, TARGET_RECALL = 8, 3, 0.4, 0.995
BANDS = math.ceil(math.log(1 - TARGET_RECALL) / math.log(1 - AGREE**BAND) / WALKS)
#: Items are worked on in blocks of so many bytes, so many blocks in one reading of the documents.
BLOCK_BYTES, BLOCKS = 1 << 20, 8
#: Windows and their walks are worked on in slices of so many bytes.
SLICE_BYTES = 1 << 21
TABLE_BITS = 22
_MULT = np.uint64(0x9E3779B97F4A7C15)


def normal(text) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "replace") if isinstance(text, str) else b""


def allowed(m: int) -> int:
    """Edits allowed for an item of m bytes; never so many that no q-gram has to be shared."""
    return max(0, min(int(EDIT_SHARE * m), (m - Q) // Q))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A TABLE_BITS-bit hash of the Q bytes (8 and 4) from each position on."""
    if len(data) < Q:
        return np.zeros(0, np.int64)
    n = len(data) - Q + 1
    buffer = np.ascontiguousarray(data)
    a = np.ndarray((n,), "<u8", buffer, 0, (1,))
    b = np.ndarray((n,), "<u4", buffer, 8, (1,))
    return ((a * _MULT ^ b * np.uint64(0xC2B2AE3D27D4EB4F)) * _MULT >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def walk_bits(walk: np.ndarray, step: int, byte: np.ndarray) -> np.ndarray:
    """The random bit, of each walk at a step, that says whether it goes on in the string behind this byte."""
    key = walk.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + byte.astype(np.uint64) * _MULT + np.uint64(step * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)
    return (mix(key) >> np.uint64(40) & np.uint64(1)).astype(np.int64)


def slices(count: int, width: int):
    """Bounds of slices of `count` rows that hold about SLICE_BYTES of `width` bytes a row."""
    size = max(1, min(2048, SLICE_BYTES // max(1, width)))
    return [(a, min(count, a + size)) for a in range(0, count, size)]


class Items:
    """A block of items, prepared for matching."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.short = [(i, t) for i, t in rows if len(t) < Q]
        self.rows = [(i, t) for i, t in rows if len(t) >= Q]
        self.length = np.array([len(t) for _, t in self.rows], np.int64)
        self.most = int(self.length.max(initial=0))
        self.edits = np.array([allowed(m) for m in self.length], np.int64)
        self.need = self.length - Q + 1 - Q * self.edits
        grams = [np.unique(gram_hashes(np.frombuffer(t, np.uint8))) for _, t in self.rows]
        self.any = np.zeros(1 << TABLE_BITS, bool)
        gram, item = np.concatenate([np.zeros(0, np.int64), *grams]), np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        self.any[gram] = True
        order = np.argsort(gram, kind="stable")
        self.gram, self.item = gram[order], item[order]
        self.bytes = np.zeros((len(self.rows), self.most + 1), np.uint8)
        for k, (_, t) in enumerate(self.rows):
            self.bytes[k, : len(t)] = np.frombuffer(t, np.uint8)
        self.picks = np.random.default_rng(99).random((WALKS, BANDS * BAND))
        keys = self.bands(self.bytes, self.length)
        self.by_key = np.argsort(keys, axis=0, kind="stable")
        self.keys = np.take_along_axis(keys, self.by_key, 0)

    def bands(self, strings: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Strings (a row each, 0 behind length) -> (strings, WALKS * BANDS) band keys of their CGK outputs."""
        n = len(strings)
        if not n:
            return np.zeros((0, WALKS * BANDS), np.uint64)
        row = np.tile(np.arange(n), WALKS)
        walk, end, at = np.repeat(np.arange(WALKS), n), np.tile(length, WALKS), np.zeros(n * WALKS, np.int64)
        # outputs behind a string's end say nothing: places are picked where walks still read
        places = (np.repeat(self.picks, n, axis=0) * 1.8 * end[:, None]).astype(np.int64)
        steps = int(places.max()) + 1
        read = np.empty((steps, n * WALKS), np.uint8)
        flat, base = strings.reshape(-1), row * strings.shape[1]
        for s in range(steps):
            read[s] = byte = flat[base + at]
            at = np.minimum(at + walk_bits(walk, s, byte), end)
        seen = read[places, np.arange(n * WALKS)[:, None]].astype(np.uint64).reshape(n * WALKS, BANDS, BAND)
        key = np.broadcast_to(end.astype(np.uint64)[:, None], seen.shape[:2]).copy()
        for j in range(BAND):
            key = (key ^ seen[:, :, j]) * _MULT
            key ^= key >> np.uint64(29)
        return key.reshape(WALKS, n, BANDS).transpose(1, 0, 2).reshape(n, WALKS * BANDS)

    def candidates(self, windows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item number) that meet in a band."""
        keys, pairs = self.bands(windows, length), [np.zeros((0, 2), np.int64)]
        for b in range(keys.shape[1]):
            known = self.keys[:, b]
            lo, hi = np.searchsorted(known, keys[:, b], "left"), np.searchsorted(known, keys[:, b], "right")
            hit = np.flatnonzero(hi > lo)
            each = (hi - lo)[hit]
            at = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(each)[:-1]]) if len(hit) else lo[:0], each) + np.arange(each.sum())
            pairs.append(np.stack([np.repeat(hit, each), self.by_key[at, b]], axis=1))
        both = np.unique(np.concatenate(pairs), axis=0)
        return both[:, 0], both[:, 1]

    def screened(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, item number, q-grams shared) of the windows that share enough of them with an item."""
        hashes = gram_hashes(data)
        at = np.flatnonzero(self.any[hashes])
        lo, hi = np.searchsorted(self.gram, hashes[at], "left"), np.searchsorted(self.gram, hashes[at], "right")
        each = hi - lo
        item = self.item[np.repeat(lo - np.concatenate([[0], np.cumsum(each)[:-1]]) if len(lo) else lo, each) + np.arange(each.sum())]
        place = np.repeat(at, each)
        order = np.argsort(item, kind="stable")
        item, place = item[order], place[order]
        cut = np.searchsorted(item, np.arange(len(self.rows) + 1))
        starts, numbers, shared = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(np.diff(cut) >= self.need):
            p, span = place[cut[k] : cut[k + 1]], self.length[k] + self.edits[k]
            # word starts from which on the window holds enough of them
            ok = p[: len(p) - self.need[k] + 1][p[self.need[k] - 1 :] - p[: len(p) - self.need[k] + 1] <= span - Q]
            near = first[np.unique(np.concatenate([np.arange(a, z) for a, z in zip(np.searchsorted(first, ok - span), np.searchsorted(first, ok, "right"), strict=True)]))] if len(ok) else ok
            share = np.searchsorted(p, near + span - Q, "right") - np.searchsorted(p, near, "left")
            enough = share >= self.need[k]
            starts.append(near[enough])
            numbers.append(np.full(int(enough.sum()), k))
            shared.append(share[enough])
        return np.concatenate(starts), np.concatenate(numbers), np.concatenate(shared)


def edit_distance(item: np.ndarray, text: np.ndarray, limit: int) -> int:
    """Least edit distance of item to a prefix of text, limit + 1 if it is more than limit.

    Furthest-reaching diagonals: after e edits, how many bytes of the item each diagonal has got through. All diagonals
    are worked on together, and there are as many rounds as the distance found, so equal strings take one.
    """
    m, n = len(item), len(text)
    # eight bytes from each place on; what stands behind the ends never agrees
    a = np.ndarray((m + 1,), "<u8", np.concatenate([item, np.full(8, 1, np.uint8)]), 0, (1,))
    b = np.ndarray((n + 1,), "<u8", np.concatenate([text, np.full(8, 2, np.uint8)]), 0, (1,))

    def extended(i: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        live = np.flatnonzero((i >= 0) & (i <= m) & (i + diagonal >= 0) & (i + diagonal <= n))
        while len(live):
            differ = a[i[live]] ^ b[i[live] + diagonal[live]]
            low = differ & (~differ + np.uint64(1))
            i[live] += np.where(differ == 0, 8, (np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64))
            live = live[differ == 0]
        return i

    far = -(1 << 40)
    reach = extended(np.zeros(1, np.int64), np.zeros(1, np.int64))
    for e in range(limit + 1):
        if (reach >= m).any():
            return e
        diagonal = np.arange(-e - 1, e + 2)
        last = np.concatenate([[far, far], reach, [far, far]])
        # a byte changed, a byte of the item left out, a byte of the text left out
        i = np.maximum(np.maximum(last[1:-1] + 1, last[2:] + 1), last[:-2])
        i = np.minimum(i, np.minimum(m, n - diagonal))
        reach = extended(np.where(i + diagonal < 0, far, i), diagonal)
    return limit + 1


def match(texts: list[bytes], items: Items, exact: bool = False) -> list[tuple[int, int, int, int]]:
    """(text number, item number in items.rows or -1 - number in items.short, distance, byte of the window's start)."""
    found: dict[tuple[int, int], tuple[int, int]] = {}
    pad = 2 * items.most + Q
    data = np.frombuffer(b"".join(t + b"\0" for t in texts) + b"\0" * pad, np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    for i, t in enumerate(texts):
        for k, (_, s) in enumerate(items.short):
            at = t.find(s)
            while at > 0 and t[at - 1] != 32:
                at = t.find(s, at + 1)
            if at >= 0:
                found[(i, -1 - k)] = (0, at)
    if not items.rows:
        return [(i, x, e, s) for (i, x), (e, s) in found.items()]
    first = np.flatnonzero(np.concatenate([[True], (data[:-1] == 32) | (data[:-1] == 0)]) & (data != 32) & (data != 0))
    near, number, share = items.screened(data, first)
    owner = np.searchsorted(begin, near, "right") - 1
    order = np.lexsort((near, -share, number, owner))
    near, number, share, owner = near[order], number[order], share[order], owner[order]
    least = items.length[number] - Q + 1

    def verify(k: np.ndarray) -> None:
        """Windows (places in near), best first: each needs to be as near as the best one of its pair so far."""
        for j in k.tolist():
            pair = (int(owner[j]), int(number[j]))
            m, edits, start = int(items.length[pair[1]]), int(items.edits[pair[1]]), int(near[j])
            best, at = found.get(pair, (edits, 1 << 60))
            limit = best if start - begin[pair[0]] < at else best - 1
            if limit < 0:
                continue
            end = min(start + m + limit, int(begin[pair[0] + 1]) - 1)
            e = edit_distance(items.bytes[pair[1], :m], data[start:end], limit)
            if e <= limit:
                found[pair] = (e, start - int(begin[pair[0]]))

    def met(k: np.ndarray) -> np.ndarray:
        """Those of the windows that meet their item in a band."""
        out = [np.zeros(0, np.int64)]
        for a, z in slices(len(k), items.bytes.shape[1]):
            start, length = near[k[a:z]], items.length[number[k[a:z]]]
            windows = data[start[:, None] + np.arange(length.max() + 1)[None, :]].copy()
            windows[np.arange(windows.shape[1])[None, :] >= length[:, None]] = 0
            w, x = items.candidates(windows, length)
            out.append(k[a:z][w[number[k[a:z]][w] == x]])
        return np.unique(np.concatenate(out))

    chosen = (lambda k: k) if exact else met
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])])[: len(near)]
    verify(chosen(np.flatnonzero(new)))
    rest = np.flatnonzero(~new)
    bound = np.array([found.get((int(i), int(x)), (int(items.edits[x]), 0))[0] for i, x in zip(owner[rest], number[rest], strict=True)], np.int64)
    verify(chosen(rest[share[rest] >= least[rest] - Q * bound]))
    return [(i, x, e, s) for (i, x), (e, s) in found.items()]


def item_blocks(benchmark: DataFrame):
    """The distinct items in blocks of about BLOCK_BYTES (items of like lengths, for they are padded), streamed to the driver."""
    rows, size = [], 0
    ordered = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null").distinct().orderBy(F.length("text"), "item_id", "text")
    for r in ordered.toLocalIterator():
        t = normal(r["text"])
        if t:
            if rows and (size + len(t) > BLOCK_BYTES or (len(rows) + 1) * len(t) > 4 * BLOCK_BYTES):
                yield rows
                rows, size = [], 0
            rows.append((r["item_id"], t))
            size += len(t)
    if rows:
        yield rows


def contaminated(docs: DataFrame, benchmark: DataFrame, exact: bool = False) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, distance, start: one row a pair.

    exact: verify all windows that pass the screen, not only those that the embedding finds.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    schema, out = "doc_id long, item_id long, distance int, start long", None
    blocks = item_blocks(benchmark)
    while group := list(itertools.islice(blocks, BLOCKS)):
        shared = [spark.sparkContext.broadcast({"given": rows}) for rows in group]  # each at most BLOCK_BYTES or one item

        def run(batches, shared=shared):
            prepared = [built_once(block, Items) for block in shared]
            for pdf in chunks(batches):
                ids, texts = pdf["doc_id"].to_numpy(), [normal(t) for t in pdf["text"]]
                found = [(ids[i], (items.rows[x] if x >= 0 else items.short[-1 - x])[0], e, s) for items in prepared for i, x, e, s in match(texts, items, exact)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "distance", "start"])

        part = docs.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start")).alias("m")).select("doc_id", "item_id", "m.distance", "m.start")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents (all columns) without those that contain an item."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["bad"], "left_anti")
