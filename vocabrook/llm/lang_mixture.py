"""Language identification by multilingual mixture inference.

A language is a distribution over hashed byte trigrams, fitted on labelled rows. A document's words get their
trigram likelihoods under every language; expectation-maximisation then estimates the document's language
proportions, and the language set is the one with the best penalised likelihood (the BIC over words) among the
1, 2, .. languages with the largest proportions. The prediction is the largest proportion of that set.

The fit uses a bounded sample of labelled rows: about TRAIN_ROWS a language, chosen by a hash of doc_id; its
tables have a fixed size a language. Scoring reads whole texts in one pass and shuffles nothing.

Defined cases: null texts and texts without a letter are `und` with score 0; an empty table, or one without
labelled rows, gives `und` for every row; repeated rows are predicted each for itself; rows with a null doc_id are
predicted and count as held out; columns other than doc_id, text and lang are not read, and lang only for the fit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, crc_fold, joined, small_batches, spans

#: Labelled rows a language that the fit may use.
TRAIN_ROWS = 2000
TABLE_BITS = 16
SMOOTH = 0.2
EM_STEPS = 6
#: The penalty for one more language, in halves of log(words): 1 is the BIC.
PENALTY = 2.0

_rng = np.random.default_rng(11)
_T = [_rng.integers(0, 1 << TABLE_BITS, 256, dtype=np.uint16) for _ in range(3)]
#: ASCII bytes other than letters separate words; so do 0xC2 (signs and spaces of Latin-1) and 0xE2 (punctuation).
_BREAK = np.array([i < 128 and not (65 <= i <= 90 or 97 <= i <= 122) or i in (0xC2, 0xE2) for i in range(256)])


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigram at each byte of a word (with one break before and after it), word starts, lengths, each text's first word."""
    raw = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
    data, begin = joined(raw)
    breaks = _BREAK[data]
    flat = np.where(breaks, np.uint8(32), data)
    starts, ends = spans(~breaks)
    grams = _T[0][flat[:-2]] ^ _T[1][flat[1:-1]] ^ _T[2][flat[2:]]  # gram k is centred on byte k + 1
    return grams, starts, ends, np.searchsorted(starts, begin)


def fit(docs: DataFrame, lang: str = "lang", rows_a_language: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """docs(doc_id, text, lang) of labelled rows -> language -> log-probabilities (float32) of hashed trigrams."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return {}
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, rows_a_language / n)))])
    unit = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.filter(F.coalesce(unit, F.lit(0.5)) < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for pdf in chunks(batches):
            for name, part in pdf.groupby("lang"):
                grams, starts, ends, _ = _trigrams(list(part["text"]))
                inside = np.zeros(len(grams) + 3, np.int8)
                inside[starts] += 1
                inside[ends] -= 1
                at = np.flatnonzero(np.cumsum(inside)[1 : len(grams) + 1])
                total[name] = total.get(name, 0) + np.bincount(grams[at], minlength=1 << TABLE_BITS)
        if total:
            yield pd.DataFrame({"lang": list(total), "counts": [c.astype("<i8").tobytes() for c in total.values()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, "<i8") for c in pdf["counts"])
        return pd.DataFrame({"lang": pdf["lang"][:1], "counts": [total.tobytes()]})

    parts = sample.mapInPandas(count, "lang string, counts binary")
    out = {}
    for r in parts.groupBy("lang").applyInPandas(add, "lang string, counts binary").toLocalIterator():
        c = np.frombuffer(r["counts"], "<i8") + SMOOTH
        out[r["lang"]] = np.log(c / c.sum()).astype(np.float32)
    return dict(sorted(out.items()))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over [first[i], first[i + 1]) of rows, 0 for empty ranges."""
    out = np.zeros((len(first) - 1, values.shape[1]), values.dtype)
    full = first[1:] > first[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0)
    return out


def _em(lik: np.ndarray, first: np.ndarray, pi: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document and the log-likelihood (without the words' common scale)."""
    n = np.diff(first)
    for _ in range(steps):
        r = lik * np.repeat(pi, n, axis=0)
        total = r.sum(axis=1, keepdims=True)
        pi = _sums(r / total, first) / np.maximum(n, 1)[:, None]
    total = (lik * np.repeat(pi, n, axis=0)).sum(axis=1, keepdims=True)
    return pi, _sums(np.log(np.maximum(total, 1e-30)), first)[:, 0]


def infer(texts: list[str], names: list[str], tables: np.ndarray) -> list[tuple[str, float, dict[str, float], float]]:
    """For each text: language, its proportion, the proportions of the chosen set, and that set's log-likelihood less the background's.

    The background gives every hashed trigram the same probability.
    """
    grams, starts, ends, first = _trigrams(texts)
    known = len(names)
    if not len(starts):
        return [("und", 0.0, {}, 0.0)] * len(texts)
    # the words' log-likelihoods by sums over trigram positions
    logs = np.empty((len(starts), known), np.float32)
    inside = np.zeros(len(grams) + 3, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    at = np.flatnonzero(np.cumsum(inside)[1 : len(grams) + 1])
    own = grams[at]
    lengths = ends - starts
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for k in range(known):
        logs[:, k] = np.add.reduceat(tables[k][own], begin)
    lik = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -20.0)).astype(np.float64)
    n = np.diff(first)
    full, _ = _em(lik, first, np.full((len(texts), known), 1.0 / known), EM_STEPS)
    rank = np.argsort(-full, axis=1, kind="stable")
    best_score, best_fit = np.full(len(texts), -np.inf), np.zeros(len(texts))
    best_pi = full
    for m in range(1, known + 1):
        pi = np.zeros_like(full)
        np.put_along_axis(pi, rank[:, :m], np.maximum(np.take_along_axis(full, rank[:, :m], 1), 1e-6), 1)
        pi /= pi.sum(axis=1, keepdims=True)
        pi, fit_ = _em(lik, first, pi, 2 if m > 1 else 0)
        score = fit_ - PENALTY * 0.5 * (m - 1) * np.log(np.maximum(n, 1) + 1.0)
        better = score > best_score
        best_score = np.where(better, score, best_score)
        best_fit = np.where(better, fit_, best_fit)
        best_pi = np.where(better[:, None], pi, best_pi)
    common = logs.max(axis=1, keepdims=True).astype(np.float64) + (lengths * TABLE_BITS * np.log(2))[:, None]
    gain = best_fit + _sums(common, first)[:, 0]
    top = np.argmax(best_pi, axis=1)
    share = np.take_along_axis(full, top[:, None], 1)[:, 0]
    out = []
    for i, text in enumerate(texts):
        if n[i] == 0 or not any(map(str.isalpha, text)):
            out.append(("und", 0.0, {}, 0.0) if not any(map(str.isalpha, text)) else (names[0], 1.0 / known, {}, 0.0))
        else:
            out.append((names[top[i]], float(min(1.0, share[i])), {names[k]: float(best_pi[i, k]) for k in np.flatnonzero(best_pi[i])}, float(gain[i])))
    return out


def identify(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, lang_pred, score, proportions map<string,double>."""
    small_batches(docs.sparkSession)
    names, kind = list(model), docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(np.stack(list(model.values())) if model else np.zeros((0, 0), np.float32))
    limit = max(100_000, CHUNK_BYTES * 4 // max(4, len(names)))

    def run(batches):
        for pdf in chunks(batches, limit=limit):
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            found = infer(texts, names, shared.value) if names else [("und", 0.0, {}, 0.0)] * len(texts)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "proportions": [f[2] for f in found]})

    rows = docs.select("doc_id", "text", (crc_fold("doc_id") == 0).alias("held_out"))
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, proportions map<string,double>")


def predict_languages(docs: DataFrame) -> DataFrame:
    """Fit on the rows outside fold 0, predict all rows."""
    return identify(docs, fit(docs.filter(crc_fold("doc_id") != 0)))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents (all columns, all rows) whose chosen languages, one or several, explain them better than the background does.

    Fitted on the labelled rows of docs itself; without any, every row stays.
    """
    model = fit(docs.filter(crc_fold("doc_id") != 0))
    if not model:
        return docs
    names = list(model)
    shared = docs.sparkSession.sparkContext.broadcast(np.stack(list(model.values())))

    @F.pandas_udf("double")
    def gain(text: pd.Series) -> pd.Series:
        parts = [pd.Series([r[3] for r in infer([t if isinstance(t, str) else "" for t in c["text"]], names, shared.value)], index=c.index) for c in chunks([pd.DataFrame({"text": text})])]
        return pd.concat(parts) if parts else pd.Series([], dtype="float64")

    return docs.filter(gain("text") > 0)
