"""Spans of a lexicon's entries in documents, a row a document, so that neither tokens nor spans are ever rows of a shuffle.

1. What tells whether a span may be an entry, 64-bit codes of the lexicon's texts, first and last words, is plain data for
   the tasks. It only drops spans: those that are left are grounded, and only what is grounded counts.
2. A task cuts its documents to tokens, numbers the distinct strings of the spans that are left, block by block, and gives
   each document's spans as packed numbers. Strings are made distinct over all blocks and grounded once.
3. Matches return to the blocks that asked for them and meet the packed spans there, block by block; the leftmost longest
   ones are chosen a document. A block's strings are bounded, a document's spans are one row, as its text is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import forms
from ..sources.tables import reused

#: Distinct strings of a block, characters that are cut at a time, annotations of an Arrow batch, tokens and strings that a task remembers.
STRINGS, CHARS, ROWS, SEEN = 200_000, 300_000, 50_000, 1 << 19
#: Entries up to which a lexicon is told to all tasks: 8 bytes each, and up to 16 for its first and last words.
MOST = 4_000_000


def code_of(words: Sequence[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if len(words) else np.empty(0, np.uint64)


def told(terms: DataFrame) -> dict | None:
    """Codes of the lexicon's normalised texts, of their first words with the number of words, and of the last of several words;
    none of a lexicon of more than MOST texts."""
    texts = terms.select("norm_text").distinct()
    if texts.limit(MOST + 1).count() > MOST:
        return None
    words = F.filter(F.split("norm_text", r"(?U)\s+"), lambda w: w != "")
    rows = texts.select("norm_text", words.alias("w")).select("norm_text", F.try_element_at("w", F.lit(1)).alias("first"), F.try_element_at("w", F.lit(-1)).alias("last"), F.size("w").alias("n"))

    def coded(batches):
        for pdf in batches:
            some, several = pdf[pdf["n"] > 0], pdf[pdf["n"] > 1]
            first = pd.DataFrame({"code": code_of(some["first"].to_numpy(object)), "n": some["n"].to_numpy()}).drop_duplicates()
            yield pd.DataFrame({"texts": [code_of(pdf["norm_text"].to_numpy(object)).tobytes()], "firsts": [first["code"].to_numpy(np.uint64).tobytes()], "sizes": [first["n"].to_numpy(np.int32).tobytes()], "lasts": [np.unique(code_of(several["last"].to_numpy(object))).tobytes()]})

    found = rows.mapInPandas(coded, "texts binary, firsts binary, sizes binary, lasts binary").collect()
    of = lambda name, kind=np.uint64: np.concatenate([np.empty(0, kind), *[np.frombuffer(r[name], kind) for r in found]])
    pairs = pd.DataFrame({"code": of("firsts"), "n": of("sizes", np.int32)}).drop_duplicates().sort_values(["code", "n"], ascending=[True, False])
    return {"texts": np.unique(of("texts")), "firsts": pairs["code"].to_numpy(np.uint64), "sizes": pairs["n"].to_numpy(np.int32), "lasts": np.unique(of("lasts"))}


def among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(codes), bool)
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


class Lexicon:
    """What a task knows of the lexicon, and of the tokens that it has seen.

    begins: tokens that entries begin with, with the entries' numbers of words, falling (1 only if the token is one itself);
    odd: tokens that may give a span several forms; odd_last: those that may as its last one; lasts: those that may be the
    last of several; refused: strings of several tokens that are no entry.
    """

    def __init__(self, codes: dict, stop_words: frozenset, core: frozenset, variants: bool):
        self.codes, self.stop_words, self.core, self.variants = codes, stop_words, core, variants
        self.seen, self.begins, self.odd, self.odd_last, self.lasts, self.refused = set(), {}, set(), set(), set(), set()

    def forms(self, raw: str) -> Sequence[str]:
        return forms.lookups(raw) if self.variants else (forms.normalized(raw),)

    def entries(self, odd: dict[str, bool]) -> list[bool]:
        """Of strings, each with whether it may have several forms: whether they may be entries."""
        asked, at = [], []
        for k, (raw, several) in enumerate(odd.items()):
            if several:
                some = self.forms(raw)
                asked += some
                at += [k] * len(some)
            else:
                asked.append(raw.lower())
                at.append(k)
        out = np.zeros(len(odd), bool)
        out[np.array(at, np.int64)[among(code_of(asked), self.codes["texts"])]] = True
        return out.tolist()

    def forget(self) -> None:
        if len(self.seen) > SEEN:
            for x in (self.seen, self.begins, self.odd, self.odd_last, self.lasts):
                x.clear()
        if len(self.refused) > SEEN:
            self.refused.clear()

    def learn(self, tokens: set[str]) -> None:
        """Tokens not seen yet, all at once."""
        tokens = list(tokens)
        words = [forms.normalized(t) for t in tokens]
        code, firsts = code_of(words), self.codes["firsts"]
        low, high = np.searchsorted(firsts, code, "left").tolist(), np.searchsorted(firsts, code, "right").tolist()
        odd = {t for t in tokens if forms.is_odd(t)}
        odd_last = {t for t in tokens if forms.is_odd_last(t)} if self.variants else set()
        begin = [k for k in range(len(tokens)) if high[k] > low[k] and words[k] not in self.core]
        single = self.entries({tokens[k]: tokens[k] in odd or tokens[k] in odd_last for k in begin})
        for k, entry in zip(begin, single, strict=True):
            alone = entry and len(tokens[k]) > 1 and words[k] not in self.stop_words
            if n := tuple(x for x in self.codes["sizes"][low[k] : high[k]].tolist() if x > 1 or alone):
                self.begins[tokens[k]] = n
        self.seen.update(tokens)
        self.odd |= odd
        self.odd_last |= odd_last
        self.lasts |= odd | odd_last | {t for t, x in zip(tokens, among(code, self.codes["lasts"]).tolist(), strict=True) if x}


def cut(lexicon: Lexicon, texts: Sequence[str], spans_of: Callable, pieces: Callable, known: dict | frozenset = frozenset()) -> list[tuple]:
    """The spans that may be entries: number of the text, string, sent, span, start, end; by start, long ones first.

    known: strings that were found before.
    """
    lexicon.forget()
    cuts, unseen = [], set()
    for k, s in enumerate(texts):
        for sent, (a, z) in enumerate(spans_of(s)):
            sentence = s[a:z]
            at = pieces(sentence)
            words = [sentence[x:y] for x, y in at]
            cuts.append((k, sent, a, at, words))
            unseen.update(words)
    lexicon.learn(unseen - lexicon.seen)
    begins, odd, odd_last, lasts, refused = lexicon.begins.get, lexicon.odd, lexicon.odd_last, lexicon.lasts, lexicon.refused
    several: dict[str, bool] = {}
    out = []
    for k, sent, a, at, words in cuts:
        m = len(words)
        for i, sizes in [(i, x) for i, w in enumerate(words) if (x := begins(w))]:
            for n in sizes:
                if n == 1:
                    out.append((k, words[i], sent, 1, a + at[i][0], a + at[i][1]))
                    continue
                j = i + n - 1
                # the last one of a word cut in two is no last word
                if j >= m or words[j] not in lasts and at[j][0] > at[j - 1][1]:
                    continue
                raw, wide = words[i], False
                for x in range(i + 1, j + 1):
                    gap = at[x][0] - at[x - 1][1]
                    wide = wide or gap != 1
                    raw += " " * gap + words[x]
                if raw in refused:
                    continue
                if raw not in known and raw not in several:
                    several[raw] = wide or words[j] in odd_last or not odd.isdisjoint(words[i : j + 1])
                out.append((k, raw, sent, n, a + at[i][0], a + at[j][1]))
    wrong = {r for r, x in zip(several, lexicon.entries(several), strict=True) if not x}
    refused |= wrong
    return [x for x in out if x[1] not in wrong] if wrong else out


def packed(docs: DataFrame, column: str, id_: str, codes: dict, spans_of: Callable, pieces: Callable, stop_words: frozenset, core: frozenset, variants: bool) -> DataFrame:
    """block, at, raws: distinct strings of a block, numbered from at; or block, id, n, spans: those of a document, packed."""
    shared = docs.sparkSession.sparkContext.broadcast(codes)
    rows = docs.select(F.col(id_).alias("id"), F.col(column).alias("text")).filter("text <> ''")
    kind, strings, chars = rows.schema["id"].dataType, STRINGS, CHARS

    def found(batches):
        lexicon, numbers, block = Lexicon(shared.value, stop_words, core, variants), {}, TaskContext.get().partitionId() << 32
        for rows in batches:
            texts, ids = rows["text"].to_pylist(), rows["id"]
            for lo, hi in runs(np.cumsum([len(t) for t in texts]) // chars):
                if len(numbers) > strings:
                    numbers, block = {}, block + 1
                spans = cut(lexicon, texts[lo:hi], spans_of, pieces, numbers)
                if not spans:
                    continue
                doc, raws, *rest = zip(*spans, strict=True)
                first = len(numbers)
                number = [numbers.setdefault(r, len(numbers)) for r in raws]
                m = np.array([*rest, number], np.int32)
                at = np.flatnonzero(np.diff(doc, prepend=-1))
                sizes, blobs = np.diff(at, append=len(doc)), []
                for x, n in zip(at.tolist(), sizes.tolist(), strict=True):
                    one = m[:, x : x + n].copy()
                    one[3] -= one[2]
                    one[2, 1:] -= m[2, x : x + n - 1]
                    blobs.append(pa.compress(one.tobytes(), codec="zstd", asbytes=True))
                fresh, none = list(islice(numbers, first, None)), [None] * len(at)
                owners = pa.concat_arrays([pa.nulls(1, ids.type), ids.take(pa.array(lo + np.array(doc)[at]))])
                columns = [pa.array([block] * len(owners)), pa.array([first, *none], pa.int32()), pa.array([fresh, *none], pa.list_(pa.string())), owners, pa.array([None, *sizes.tolist()], pa.int32()), pa.array([None, *blobs], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "at", "raws", "id", "n", "spans"])

    return rows.mapInArrow(found, f"block long, at int, raws array<string>, id {kind.simpleString()}, n int, spans binary")


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Half-open ranges of equal values."""
    at = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    yield from (x for x in zip(at[:-1], at[1:], strict=True) if x[0] < x[1])


def leftmost(starts: list[int], ends: list[int]) -> list[int]:
    """Places of the spans that are taken from left to right, the first of equal starts, without overlaps."""
    out, following = [], 0
    for k, (a, z) in enumerate(zip(starts, ends, strict=True)):
        if a >= following:
            out.append(k)
            following = z
    return out


def chosen(spans: DataFrame, answers: DataFrame) -> DataFrame:
    """spans(block, id, n, spans) as packed() has them, answers(block, code, answer struct) -> id, annotations: an array of
    structs, in order of the text, sent, span, start, end and the answer's fields. Documents without any have no row."""
    kind, told_ = spans.schema["id"].dataType.simpleString(), answers.schema["answer"].dataType
    null = lambda k: F.lit(None).cast(k)
    left = answers.select("block", F.lit(0).alias("kind"), "code", "answer", null(kind).alias("id"), null("int").alias("n"), null("binary").alias("spans"))
    right = spans.select("block", F.lit(1).alias("kind"), null("int").alias("code"), null(told_).alias("answer"), "id", "n", "spans")
    rows = left.unionByName(right).repartition("block").sortWithinPartitions("block", "kind")
    most, fields = ROWS, "".join(f", {f.name}: {f.dataType.simpleString()}" for f in told_.fields)

    def batch(ids: pa.Array, where: list, sizes: list, numbers: list, at: list, answered: pa.StructArray) -> pa.RecordBatch:
        answers = answered.take(pa.array(np.concatenate(at)))
        own = [pa.array(x) for x in np.concatenate(numbers, axis=1)]
        one = pa.StructArray.from_arrays([*own, *answers.flatten()], names=["sent", "span", "start", "end", *[f.name for f in told_.fields]])
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(where)), pa.ListArray.from_arrays(offsets, one)], names=["id", "annotations"])

    def taken(batches):
        now, parts, codes, place, answered = None, [], [], None, None
        for rows in batches:
            block, kinds = rows["block"].to_numpy(), rows["kind"].to_numpy()
            for lo, hi in runs(block * 2 + kinds):
                if block[lo] != now:
                    now, parts, codes, place, answered = block[lo], [], [], None, None
                if not kinds[lo]:
                    parts.append(rows["answer"][lo:hi])
                    codes.append(rows["code"][lo:hi].to_numpy())
                    continue
                if not parts and answered is None:
                    continue
                if answered is None:
                    known, answered = np.concatenate(codes), pa.concat_arrays(parts)
                    place = np.full(known.max() + 2, -1)
                    place[known] = np.arange(len(known))
                    parts, codes = [], []
                where, sizes, numbers, at, total = [], [], [], [], 0
                for k in range(lo, hi):
                    n = rows["n"][k].as_py()
                    m = np.frombuffer(pa.decompress(rows["spans"][k].as_buffer(), 20 * n, codec="zstd"), np.int32).reshape(5, n)
                    to = place[np.minimum(m[4], len(place) - 1)]
                    m = np.stack([m[0], m[1], start := np.cumsum(m[2], dtype=np.int32), start + m[3]])
                    hit = np.flatnonzero(to >= 0)
                    hit = hit[leftmost(m[2, hit].tolist(), m[3, hit].tolist())]
                    if len(hit):
                        where.append(k)
                        sizes.append(len(hit))
                        numbers.append(m[:, hit])
                        at.append(to[hit])
                        total += len(hit)
                    if total >= most:
                        yield batch(rows["id"], where, sizes, numbers, at, answered)
                        where, sizes, numbers, at, total = [], [], [], [], 0
                if where:
                    yield batch(rows["id"], where, sizes, numbers, at, answered)

    return rows.mapInArrow(taken, f"id {kind}, annotations array<struct<sent: int, span: int, start: int, end: int{fields}>>")


def found_spans(docs: DataFrame, column: str, id_: str, codes: dict, answer: Callable[[DataFrame], DataFrame], spans_of: Callable, pieces: Callable, stop_words: Sequence[str], core: Sequence[str], variants: bool) -> DataFrame:
    """id, annotations as chosen() has them. answer(raw, ..): rows of distinct strings -> raw, answer struct of those that have a match."""
    # read twice: by the distinct strings to be grounded, and by what is joined back
    spans = reused(packed(docs, column, id_, codes, spans_of, pieces, frozenset(stop_words), frozenset(core), variants))
    raws = spans.filter("raws is not null").select("block", "at", F.posexplode("raws").alias("k", "raw")).select("block", (F.col("at") + F.col("k")).alias("code"), "raw")
    answers = raws.hint("merge").join(answer(raws.select("raw").distinct()), "raw").select("block", "code", "answer")
    return chosen(spans.filter("spans is not null"), answers)
