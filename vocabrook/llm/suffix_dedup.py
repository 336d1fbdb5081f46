"""Exact removal of byte strings that repeat across documents, by sharded suffix arrays.

A byte is removed if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id; all
strings are judged on the input.

1. Anchors: of the GRAM-byte grams inside every string of LENGTH bytes, the one with the smallest hash. Equal strings have
   anchors with equal grams. The strings of one anchor are a context: 50 to 80 bytes.
2. Contexts are dealt to buckets by their gram as (gram, code, row, place) without their bytes; the code is a hash of all
   its bytes. Of equal contexts only those of the smallest doc_id go on: the others are removed whole. A task does the same
   first, so of a group of copies it sends one. Only grams with several contexts in several documents go on.
3. Suffix arrays: the bytes of these contexts are fetched, each gram's go to one shard, and shards are sorted by induced
   sorting. Suffixes are classified, leftmost-smaller substrings are sorted and named (equal names are compared byte by
   byte), the names' order is found by rank doubling where they repeat, the array is induced bucket by bucket in linear
   time, and permuted common prefixes tell which suffixes share LENGTH bytes: a string's smallest doc_id.

Defined cases: a null text is empty; rows with a null doc_id neither remove nor lose bytes; rows with one doc_id
are one document's texts (they do not remove from each other); an empty table gives no rows; other columns are not
read. Texts are never cut; very long ones are worked on whole, a document at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, mix, settle, small_batches

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1  # grams in a string
#: Contexts: so many in a bucket on average, and so many in a task before they are sent.
BUCKET_ENTRIES = 700_000
SEND_ENTRIES = 500_000
#: A text has an anchor for about so many bytes.
ANCHOR_BYTES = 15
#: A shard's contexts have so many bytes, on average.
SHARD_BYTES = 2_000_000


# ---- suffix arrays ---------------------------------------------------------------------------


def classify(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S-type flags of all suffixes (the last one is S) and the leftmost S positions."""
    n = len(x)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(x[1:].astype(np.int32) - x[:-1])
    step[-1] = 1
    known = np.where(step != 0, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(known[::-1])[::-1]  # the next position whose neighbour differs decides
    s_type = step[nearest] > 0
    return s_type, np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1


def induce(x: np.ndarray, s_type: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array induced from leftmost-S suffixes in the given order, a bucket of a first symbol at a time."""
    size = int(x.max()) + 1
    order = np.argsort(x[lms], kind="stable")
    stars = np.split(lms[order], np.cumsum(np.bincount(x[lms], minlength=size))[:-1])

    def deal(prev: np.ndarray, into: list) -> None:
        """Append to the buckets of the first symbols, in order."""
        symbol = x[prev]
        turn = np.argsort(symbol, kind="stable")
        count = np.bincount(symbol, minlength=size)
        for c, part in zip(np.flatnonzero(count), np.split(prev[turn], np.cumsum(count[count > 0])[:-1]), strict=True):
            into[c].append(part)

    larger: list[list[np.ndarray]] = [[] for _ in range(size)]
    for c in range(size):
        at = 0
        while at < len(larger[c]):  # entries of this bucket that the bucket itself induces come next
            part, at = np.concatenate(larger[c][at:]), len(larger[c])
            prev = part[part > 0] - 1
            prev = prev[~s_type[prev]]
            if len(prev):
                deal(prev, larger)
        prev = stars[c][stars[c] > 0] - 1
        if len(prev):
            deal(prev, larger)
    l_sorted = [np.concatenate(b) if b else lms[:0] for b in larger]
    smaller: list[list[np.ndarray]] = [[] for _ in range(size)]  # reversed order: largest suffix first
    for c in range(size - 1, -1, -1):
        at = 0
        while at < len(smaller[c]):
            part, at = np.concatenate(smaller[c][at:]), len(smaller[c])
            prev = part[part > 0] - 1
            prev = prev[s_type[prev]]
            if len(prev):
                deal(prev, smaller)
        part = l_sorted[c][::-1]
        prev = part[part > 0] - 1
        prev = prev[s_type[prev]]
        if len(prev):
            deal(prev, smaller)
    out = []
    for c in range(size):
        out.append(l_sorted[c])
        if smaller[c]:
            out.append(np.concatenate(smaller[c])[::-1])
    sa = np.concatenate(out)
    # the last suffix (the sentinel) is induced by none
    return np.concatenate([[len(x) - 1], sa]) if len(sa) == len(x) - 1 else sa


def rank_doubling(names: np.ndarray) -> np.ndarray:
    """The suffix array of a string of names, its last one the unique smallest."""
    n, k = len(names), 1
    rank = names.astype(np.int64)
    order = np.argsort(rank)
    while True:
        # only places whose rank is shared are sorted again, by the rank k further on
        group = rank[order]
        edge = np.concatenate([[True], group[1:] != group[:-1], [True]])
        shared = np.flatnonzero(~(edge[:-1] & edge[1:]))
        if not len(shared):
            return order
        own = order[shared]
        follow = np.where(own + k < n, rank[np.minimum(own + k, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + follow
        turn = np.argsort(key)
        order[shared] = own[turn]
        key = key[turn]
        # a rank is the first place of its group
        new = np.where(np.concatenate([[True], key[1:] != key[:-1]]), shared, -1)
        rank[order] = np.where(edge[:-1], np.arange(n), -1)
        rank[order[shared]] = new
        rank[order] = np.maximum.accumulate(rank[order])
        k *= 2


def words_of(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one number; zeros follow the data."""
    return np.ndarray((len(data) + 64,), "<u8", np.concatenate([data, np.zeros(72, np.uint8)]), 0, (1,))


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether length bytes from a on equal those from b on; what lies behind the data are zeros."""
    words, out = words_of(data), np.ones(len(a), bool)
    live, step = np.arange(len(a)), 0
    while len(live):
        left = length[live] - step
        mask = np.where(left >= 8, np.uint64(2**64 - 1), (np.uint64(1) << (8 * np.clip(left, 0, 7)).astype(np.uint64)) - np.uint64(1))
        end = len(words) - 1
        same = (words[np.minimum(a[live] + step, end)] ^ words[np.minimum(b[live] + step, end)]) & mask == 0
        out[live[~same]] = False
        live, step = live[same & (left > 8)], step + 8
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array of bytes, by induced sorting; position len(data) stands for the empty suffix, the first one."""
    x = np.concatenate([data.astype(np.int16) + 1, [0]])
    s_type, lms = classify(x)
    if len(lms) <= 1:
        return induce(x, s_type, lms)
    rough = induce(x, s_type, lms)  # sorts the leftmost-S substrings
    is_lms = np.zeros(len(x), bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    # names: equal substrings have equal lengths and bytes (their types follow)
    number = np.empty(len(x), np.int64)
    number[lms] = np.arange(len(lms))
    length = np.diff(np.concatenate([lms, [len(x)]])) + 1
    power = np.cumprod(np.full(len(x), 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
    stop = np.minimum(lms + length, len(x))
    scaled = (total[stop] - total[lms]) * power[len(x) - 1 - lms]  # moved to a common power
    k = number[ordered]
    same = (scaled[k[1:]] == scaled[k[:-1]]) & (length[k[1:]] == length[k[:-1]])
    same[same] = equal_bytes(data, lms[k[1:][same]], lms[k[:-1][same]], length[k[1:][same]])
    name = np.empty(len(lms), np.int64)
    name[k] = np.concatenate([[0], np.cumsum(~same)])
    if name[k[-1]] < len(lms) - 1:
        return induce(x, s_type, lms[rank_doubling(name)])
    return induce(x, s_type, ordered)


def common_prefixes(data: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """PLCP, at most cap: for each position, the prefix it shares with the suffix before it in the array; 8 bytes a step."""
    n = len(data)
    phi = np.full(n + 1, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    words = np.ndarray((n + cap + 16,), "<u8", np.concatenate([data, np.zeros(cap + 24, np.uint8)]), 0, (1,))
    out = np.zeros(n, np.int64)
    live = np.flatnonzero((phi[:n] >= 0) & (phi[:n] < n))
    for step in range(0, cap, 8):
        if not len(live):
            break
        gap = words[live + step] ^ words[phi[live] + step]
        whole = gap == 0
        low = gap[~whole] & (~gap[~whole] + np.uint64(1))
        out[live[~whole]] = step + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[whole]
        out[live] = step + 8
    limit = n - np.arange(n)
    return np.minimum(out, np.minimum(cap, np.minimum(limit, np.where(phi[:n] >= 0, n - phi[:n], 0))))


# ---- anchors and contexts --------------------------------------------------------------------


def encode(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each position on; data is GRAM bytes longer than the result."""
    n = len(data) - GRAM
    a, b, c = (np.ndarray((n,), "<u8", data, k, (1,)) for k in (0, 8, GRAM - 8))
    h = a * np.uint64(0x9E3779B97F4A7C15) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) + (a >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + c * np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xE7037ED1A0B428DB)
    return h ^ (h >> np.uint64(32))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, code, text number, first byte and size of each anchor's context (a string has one anchor)."""
    data = np.frombuffer(b"".join(texts) + b"\0" * (GRAM + 64), np.uint8)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(length)])
    h = gram_hashes(data)
    six = np.uint64(63)
    # of equal grams the position decides, counted from the text's start: the same wherever the text stands
    base = np.concatenate([np.repeat(begin[:-1], length), np.full(len(h) - begin[-1], begin[-1])])
    low = (h & ~six) | ((np.arange(len(h)) - base).astype(np.uint64) & six)
    # smallest of SPAN neighbours, by doubling
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < SPAN:
        low = np.minimum(low[: -(SPAN - width)], low[SPAN - width :])
    count = np.maximum(length - LENGTH + 1, 0)
    start = np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    place = start + ((low[start] & six).astype(np.int64) - (start - base[start]) & 63)
    # neighbouring strings with one anchor: a string's anchor never lies before that of the string before it
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else place
    last = np.concatenate([cut[1:], [len(place)]])[: len(cut)] - 1
    owner = np.searchsorted(begin, place[cut], "right") - 1
    first, size = start[cut], start[last] - start[cut] + LENGTH
    code = np.zeros(len(cut), np.uint64)
    for k in range(0, LENGTH + SPAN - 1, GRAM):  # grams that cover the context
        code = mix(code + h[first + np.minimum(k, size - GRAM)] * np.uint64(0x9E3779B97F4A7C15))
    # an anchor's hash is the smallest of many: mixed, so that grams spread evenly over buckets
    return mix(h[place[cut]]), mix(code + size.astype(np.uint64)), owner, first - begin[owner], size


#: The columns of a context: gram, code, row number, first byte, size.
_KINDS = ("<u8", "<u8", "<u4", "<i4", "u1")


def _settled(gram, code, doc, order) -> tuple[np.ndarray, np.ndarray]:
    """In this order of contexts: which have an equal one in a smaller document, and where equal ones begin."""
    gram, code, doc = gram[order], code[order], doc[order]
    first = np.concatenate([[True], (gram[1:] != gram[:-1]) | (code[1:] != code[:-1])])
    return doc > doc[np.flatnonzero(first)][np.cumsum(first) - 1], first


def _dealt(buckets: int):
    """Contexts dealt to buckets, in columns of bytes; without a gram: those that are known to be removed."""

    def pack(parts):
        gram, code, row, at, size, docs, prints = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((docs[row], code, gram))
        gone, _ = _settled(gram, code, docs[row], order)

        def packed(bucket, part, with_gram):
            used, number = np.unique(row[part], return_inverse=True)
            columns = [gram[part], code[part]] if with_gram else [gram[:0], code[:0]]
            columns += [number, at[part], size[part]]
            return (bucket, *[c.astype(kind).tobytes() for c, kind in zip(columns, _KINDS, strict=True)], docs[used].astype("<i8").tobytes(), prints[used].astype("<i8").tobytes())

        rows = [packed(int(gram[0] % np.uint64(buckets)), order[gone], False)] if gone.any() else []
        rest = order[~gone]
        bucket = ((gram[rest] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        rows += [packed(b, rest[cut[b] : cut[b + 1]], True) for b in range(buckets) if cut[b] < cut[b + 1]]
        for k in range(0, len(rows), 20):  # in small batches, for the memory of both sides
            yield pd.DataFrame(rows[k : k + 20], columns=["bucket", "gram", "code", "row", "at", "size", "docs", "prints"])

    def run(batches):
        parts, entries, rows = [], 0, 0
        for pdf in chunks(batches):
            gram, code, owner, at, size = anchors([encode(t) for t in pdf["text"]])
            parts.append((gram, code, (owner + rows).astype(np.uint32), at.astype(np.int32), size.astype(np.uint8), pdf["doc_id"].to_numpy(np.int64), pdf["print"].to_numpy(np.int64)))
            entries, rows = entries + len(gram), rows + len(pdf)
            if entries > SEND_ENTRIES:
                yield from pack(parts)
                parts, entries, rows = [], 0, 0
        if entries:
            yield from pack(parts)

    return run


_FOUND = "doc long, print long, at int, size int, gram long"


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Contexts to be removed (gram null) and those whose grams have others, of other documents."""
    done, open_ = [], []
    for r in pdf.itertuples(index=False):
        gram, code, row, at, size = (np.frombuffer(c, kind) for c, kind in zip((r.gram, r.code, r.row, r.at, r.size), _KINDS, strict=True))
        docs, prints = np.frombuffer(r.docs, "<i8"), np.frombuffer(r.prints, "<i8")
        (open_ if len(gram) else done).append((gram, code, docs[row], prints[row], at, size))
    out = []
    for _, _, doc, print_, at, size in done:
        out.append(pd.DataFrame({"doc": doc, "print": print_, "at": at, "size": size.astype(np.int32), "gram": pd.array([pd.NA] * len(doc), "Int64")}))
    if open_:
        gram, code, doc, print_, at, size = (np.concatenate(c) for c in zip(*open_, strict=True))
        order = np.lexsort((doc, code, gram))
        gone, first = _settled(gram, code, doc, order)
        rest = order[~gone]
        g, d, new = gram[rest], doc[rest], first[~gone]
        ends = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
        several = (np.add.reduceat(new.astype(np.int64), ends[:-1]) > 1) & (np.minimum.reduceat(d, ends[:-1]) < np.maximum.reduceat(d, ends[:-1]))
        rest = rest[np.repeat(several, np.diff(ends))]
        for part, keys in ((order[gone], False), (rest, True)):
            key = pd.array(gram[part].view(np.int64), "Int64") if keys else pd.array([pd.NA] * len(part), "Int64")
            out.append(pd.DataFrame({"doc": doc[part], "print": print_[part], "at": at[part], "size": size[part].astype(np.int32), "gram": key}))
    return pd.concat(out, ignore_index=True)


def _fetched(batches):
    """gram, context, doc, print, at: the bytes of the listed contexts."""
    for pdf in chunks(batches):
        rows = []
        for doc, print_, text, grams, ats, sizes in zip(pdf["doc_id"], pdf["print"], pdf["text"], pdf["grams"], pdf["ats"], pdf["sizes"], strict=True):
            b = encode(text)
            rows += [(g, b[a : a + n], doc, print_, a) for g, a, n in zip(grams.tolist(), ats.tolist(), sizes.tolist(), strict=True)]
        yield pd.DataFrame(rows, columns=["gram", "context", "doc", "print", "at"])


def shard_strings(contexts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (context number, first string, last string, smallest doc) of the strings of LENGTH bytes, by a suffix array."""
    data = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8)
    length = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begin = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    sa = suffix_array(data)
    share = common_prefixes(data, sa, LENGTH)
    sa = sa[sa < len(data)]
    owner = np.repeat(np.arange(len(contexts)), length + 1)
    inside = np.arange(len(data)) - begin[owner]
    fits = inside + LENGTH <= length[owner]
    sa = sa[fits[sa]]
    if not len(sa):
        return (np.zeros(0, np.int64),) * 4
    # a suffix that shares fewer bytes with the one before it begins a new string; others keep theirs
    head = np.flatnonzero(np.concatenate([[True], share[sa[1:]] < LENGTH]))
    least = np.minimum.reduceat(docs[owner[sa]], head)
    of = np.empty(len(data), np.int64)
    of[sa] = np.repeat(least, np.diff(np.concatenate([head, [len(sa)]])))
    where = np.flatnonzero(fits)
    cut = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1] + 1) | (of[where[1:]] != of[where[:-1]])]))
    last = np.concatenate([cut[1:], [len(where)]]) - 1
    return owner[where[cut]], inside[where[cut]], inside[where[last]], of[where[cut]]


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    docs, at = pdf["doc"].to_numpy(np.int64), pdf["at"].to_numpy(np.int64)
    number, first, last, least = shard_strings(list(pdf["context"]), docs)
    lost = least < docs[number]
    number, first, last = number[lost], first[lost], last[lost]
    return pd.DataFrame({"doc": docs[number], "print": pdf["print"].to_numpy()[number], "first": at[number] + first, "last": at[number] + last + LENGTH})


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a print that tells texts of one doc_id apart."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    return docs.withColumn("print", F.xxhash64("text"))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc, print, firsts, lasts: arrays of the bytes [first, last) to be removed, not yet merged."""
    small_batches(docs.sparkSession)
    docs = texts_of(docs).filter(F.octet_length("text") >= LENGTH)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = total // ANCHOR_BYTES // BUCKET_ENTRIES + 1
    columns = "bucket int, gram binary, code binary, row binary, at binary, size binary, docs binary, prints binary"
    found = settle(docs.mapInPandas(_dealt(buckets), columns).groupBy("bucket").applyInPandas(_bucket, _FOUND), "found")
    places = found.filter("gram is not null")
    shards = (places.agg(F.sum("size")).first()[0] or 0) // SHARD_BYTES + 1
    places = places.groupBy(F.col("doc").alias("doc_id"), "print").agg(F.collect_list(F.struct("gram", "at", "size")).alias("places"))
    places = places.select("doc_id", "print", F.col("places.gram").alias("grams"), F.col("places.at").alias("ats"), F.col("places.size").alias("sizes"))
    contexts = docs.join(places, ["doc_id", "print"]).mapInPandas(_fetched, "gram long, context binary, doc long, print long, at int")
    contexts = contexts.withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards)))
    hits = settle(contexts.groupBy("shard").applyInPandas(_shard, "doc long, print long, first int, last int"), "hits")
    whole = found.filter("gram is null").select("doc", "print", F.col("at").alias("first"), (F.col("at") + F.col("size")).alias("last"))
    runs = hits.unionByName(whole).groupBy("doc", "print").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    runs = settle(runs.select("doc", "print", F.col("runs.first").alias("firsts"), F.col("runs.last").alias("lasts")), "runs")
    discard(found, hits)
    return runs


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs, in order; runs that touch are one."""
    order = np.argsort(first)
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate([[True], first[1:] > last[:-1]])
    return first[new], last[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(last) - 1]])]


def cut(text: str, first: np.ndarray, last: np.ndarray) -> bytes:
    """The text's bytes without maximal runs."""
    b = encode(text)
    return b"".join(b[a:z] for a, z in zip([0, *last.tolist()], [*first.tolist(), len(b)], strict=True))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, spans array<struct(first, last)>, kept binary, one row a document row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = repeated_runs(docs)
    rows = docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("print"))
    rows = rows.join(runs, ["doc", "print"], "left").select("doc_id", "text", "firsts", "lasts")

    def apply(batches):
        none = np.zeros(0, np.int64)
        for pdf in chunks(batches):
            out = []
            for doc_id, text, first, last in zip(pdf["doc_id"], pdf["text"], pdf["firsts"], pdf["lasts"], strict=True):
                first, last = (none, none) if first is None else merged(first, last)
                spans = [{"first": a, "last": z} for a, z in zip(first.tolist(), last.tolist(), strict=True)]
                out.append((doc_id, len(encode(text)), int((last - first).sum()), spans, cut(text, first, last)))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept"]).astype({"doc_id": pdf["doc_id"].dtype})

    return rows.mapInPandas(apply, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<first:long,last:long>>, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, str]) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256), by a table of all strings; for tests."""
    first: dict[bytes, int] = {}
    for doc in sorted(texts):
        b = encode(texts[doc])
        for i in range(len(b) - LENGTH + 1):
            first.setdefault(b[i : i + LENGTH], doc)
    out = {}
    for doc in texts:
        b = encode(texts[doc])
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - LENGTH + 1):
            if first[b[i : i + LENGTH]] < doc:
                gone[i : i + LENGTH] = True
        edge = np.diff(np.concatenate([[0], gone.view(np.int8)]))
        out[doc] = (len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=False) if not g)).hexdigest())
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents (all columns, all rows) with repeated bytes cut out of text; n_chars, if there, is counted again.

    Bytes of a character that was cut in two are dropped; a null text stays null.
    """
    runs = repeated_runs(docs)

    @F.pandas_udf("string")
    def rest(text: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.Series:
        return pd.Series([cut(t, *merged(a, z)).decode("utf-8", "ignore") for t, a, z in zip(text, firsts, lasts, strict=True)], dtype=object)

    # the document's row stays whole in a column, so that no name of its columns can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("print"))
    rows = rows.join(runs, ["doc", "print"], "left")
    # texts without a run do not go to Python
    touched = rows.filter("firsts is not null").withColumn("text", rest("row.text", "firsts", "lasts"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    touched = touched.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
    return touched.unionByName(rows.filter("firsts is null").select("row.*"))
