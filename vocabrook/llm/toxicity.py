"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a word: word evidence (log-odds of its hash in toxic and other training documents, and a fixed hashed
vector) and character evidence (largest and mean log-odds of its character 4-grams, and their mean hashed
vector). A window of WINDOW words runs through a GRU in both directions, attention pools its states, and a
logistic unit gives its logit. Windows overlap by half; all of them are scored, and a document's logit is that of
its worst window, calibrated on the training documents.

The fit uses a bounded sample of labelled rows: at most TRAIN_TOXIC toxic and TRAIN_OTHER other ones, chosen by a
hash of doc_id, with texts of at most TRAIN_CHARS characters. In training, each document's own contribution is
taken out of the log-odds. Scoring reads whole texts in one pass and shuffles nothing.

Defined cases: null and empty texts, and texts without words, get the training sample's share of toxic rows; a
table without labels of both kinds scores 0 everywhere; several labels of a doc_id count as their maximum; null
labels are no labels; rows with a null doc_id are scored and count as held out; repeated rows are scored each for
itself; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_fold, joined, mix, small_batches, spans, word_hashes

TRAIN_TOXIC, TRAIN_OTHER, TRAIN_CHARS = 1500, 2500, 50_000
WINDOW, STRIDE, HIDDEN = 32, 16, 8
BITS = 18
EPOCHS, ROUNDS, BATCH, RATE = 3, 3, 256, 0.02
#: Gradient steps of a round at least, for small samples.
STEPS = 60
_BREAK = np.array([i < 128 and not (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122) for i in range(256)])
_GRAM = [np.random.default_rng(5 + j).integers(1, 2**63, 256, dtype=np.uint64) for j in range(4)]
_FIXED = np.random.default_rng(17).normal(0, 0.3, (2, 1 << 10, 3)).astype(np.float32)
INPUTS = 9


def words_of(texts: list[str]):
    """Distinct words as (word bucket, gram buckets, first gram of each word), each occurrence's word, first word of each text."""
    data, begin = joined([t.lower().encode("utf-8", "replace") for t in texts])
    breaks = _BREAK[data]
    starts, ends = spans(~breaks)
    first = np.searchsorted(starts, begin)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), first
    hashes = word_hashes(data, starts, ends)
    _, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    word = (hashes[one] >> np.uint64(64 - BITS)).astype(np.int64)
    # 4-grams of "_word_": one that starts at each byte from the break before the word on, the last ends at the break after it
    flat = np.concatenate([[32], np.where(breaks, 32, data), [32, 32, 32]]).astype(np.uint8)
    s, lengths = starts[one], np.maximum(ends[one] - starts[one] - 1, 1)
    from_ = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.repeat(s, lengths) + np.arange(lengths.sum()) - np.repeat(from_, lengths)
    grams = (mix(_GRAM[0][flat[at]] ^ (_GRAM[1][flat[at + 1]] * np.uint64(3)) ^ (_GRAM[2][flat[at + 2]] * np.uint64(5)) ^ (_GRAM[3][flat[at + 3]] * np.uint64(7))) >> np.uint64(64 - BITS)).astype(np.int64)
    return word, grams, from_, inverse, first


def odds(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    lo = np.log((toxic + 0.5) / (n_toxic + 1.0)) - np.log((other + 0.5) / (n_other + 1.0))
    return np.where(toxic + other > 1, np.clip(lo, -3.0, 5.0), 0.0).astype(np.float32)


def inputs(word, grams, from_, word_odds, gram_odds) -> np.ndarray:
    """(distinct words, INPUTS)."""
    out = np.zeros((len(word), INPUTS), np.float32)
    if len(word):
        g = gram_odds[grams]
        count = np.diff(np.concatenate([from_, [len(grams)]]))[:, None]
        out[:, 0] = word_odds[word]
        out[:, 1] = np.maximum.reduceat(g, from_)
        out[:, 2] = np.add.reduceat(g, from_) / count[:, 0]
        out[:, 3:6] = _FIXED[0][word & 1023]
        out[:, 6:9] = np.add.reduceat(_FIXED[1][grams & 1023], from_, axis=0) / count
    return out


def windows_of(inverse: np.ndarray, first: np.ndarray):
    """All overlapping windows: (windows, WINDOW) word numbers with -1 behind the end, and each one's text."""
    n = np.diff(first)
    each = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    owner = np.repeat(np.arange(len(n)), each)
    number = np.arange(each.sum()) - np.repeat(np.concatenate([[0], np.cumsum(each)[:-1]]), each)
    at = number[:, None] * STRIDE + np.arange(WINDOW)[None, :]
    inside = at < n[owner][:, None]
    position = first[:-1][owner][:, None] + np.where(inside, at, 0)
    return np.where(inside, inverse[position], -1) if len(owner) else np.zeros((0, WINDOW), np.int64), owner


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


class Network:
    """Parameters by name: f_/b_ W (INPUTS, 3H), U (H, 3H), c (3H) for both directions, v (2H), w (2H), bias."""

    def __init__(self, seed: int = 1):
        rng, h = np.random.default_rng(seed), HIDDEN
        self.p = {}
        for d in "fb":
            self.p |= {f"{d}W": rng.normal(0, 0.3, (INPUTS, 3 * h)), f"{d}U": rng.normal(0, 0.3, (h, 3 * h)), f"{d}c": np.zeros(3 * h)}
        self.p |= {"v": rng.normal(0, 0.3, 2 * h), "w": rng.normal(0, 0.3, 2 * h), "bias": np.zeros(1)}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def _run(self, d: str, xw: np.ndarray, mask: np.ndarray, keep: bool):
        """xw (T, B, 3H): projected inputs in time order; mask (T, B). States (T, B, H) and what backward() needs."""
        h, n_h = np.zeros((xw.shape[1], HIDDEN), np.float32), HIDDEN
        states, cache = np.empty((*xw.shape[:2], n_h), np.float32), []
        u = self.p[d + "U"]
        for t in range(len(xw)) if d == "f" else range(len(xw) - 1, -1, -1):
            a, b = xw[t], h @ u
            zr = _sigmoid(a[:, : 2 * n_h] + b[:, : 2 * n_h])
            z, r = zr[:, :n_h], zr[:, n_h:]
            c = np.tanh(a[:, 2 * n_h :] + r * b[:, 2 * n_h :])
            m = mask[t][:, None]
            new = h + m * (1.0 - z) * (c - h)
            if keep:
                cache.append((t, h, z, r, c, b[:, 2 * n_h :], m))
            states[t] = h = new
        return states, cache

    def forward(self, table: np.ndarray | None, ids: np.ndarray, x: np.ndarray | None = None, keep: bool = False):
        """Logits of windows; table holds the projected inputs of both directions for every distinct word, or x the inputs."""
        mask = (ids >= 0).T.astype(np.float32)
        k = 3 * HIDDEN
        if x is None:
            # row by row of time: (T, B, 6H)
            both = table[np.where(ids >= 0, ids, 0).T]
            xf, xb = both[..., :k], both[..., k:]
        else:
            xt = x.transpose(1, 0, 2)
            xf, xb = xt @ self.p["fW"] + self.p["fc"], xt @ self.p["bW"] + self.p["bc"]
        sf, cf = self._run("f", xf, mask, keep)
        sb, cb = self._run("b", xb, mask, keep)
        s = np.concatenate([sf, sb], axis=2)
        e = s @ self.p["v"] + (mask - 1.0) * 1e9
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", alpha, s)
        logit = pooled @ self.p["w"] + self.p["bias"]
        return (logit, (xt, s, alpha, pooled, cf, cb)) if keep else logit

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.p["fW"] + self.p["fc"], x @ self.p["bW"] + self.p["bc"]], axis=1).astype(np.float32)

    def backward(self, kept, dlogit: np.ndarray) -> dict[str, np.ndarray]:
        xt, s, alpha, pooled, cf, cb = kept
        n_h, g = HIDDEN, {}
        g["w"], g["bias"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
        dpool = dlogit[:, None] * self.p["w"]
        dalpha = np.einsum("bh,tbh->tb", dpool, s)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        g["v"] = np.einsum("tb,tbh->h", de, s)
        ds = alpha[:, :, None] * dpool[None] + de[:, :, None] * self.p["v"]
        for d, cache, part in (("f", cf, ds[..., :n_h]), ("b", cb, ds[..., n_h:])):
            u, dh = self.p[d + "U"], np.zeros_like(part[0])
            gu, gw, gc = np.zeros_like(u), np.zeros_like(self.p[d + "W"]), np.zeros_like(self.p[d + "c"])
            for t, h, z, r, c, bn, m in reversed(cache):
                dh = dh + part[t]
                dc = dh * m * (1 - z) * (1 - c * c)
                dz = -dh * m * (c - h) * z * (1 - z)
                dr = dc * bn * r * (1 - r)
                da = np.concatenate([dz, dr, dc], axis=1)
                db = np.concatenate([dz, dr, dc * r], axis=1)
                gu += h.T @ db
                gw += xt[t].T @ da
                gc += da.sum(axis=0)
                dh = dh * (1 - m * (1 - z)) + db @ u.T
            g |= {d + "U": gu, d + "W": gw, d + "c": gc}
        return g


def sample_labels(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """text, toxic of the training sample; at most TRAIN_TOXIC + TRAIN_OTHER rows."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(crc_fold("doc_id") != 0)
    part = lambda cond, n: known.filter(cond).orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(n)
    chosen = part("toxic = 1", TRAIN_TOXIC).unionByName(part("toxic <> 1", TRAIN_OTHER))
    # the sample is bounded by its parameters, so it can be broadcast
    rows = docs.filter(F.length("text") <= TRAIN_CHARS).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # of several texts of a doc_id, the first by value: fits are repeatable
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id", kind="stable")


def fit(sample: pd.DataFrame) -> dict | None:
    """The model: odds tables, network, calibration, prior."""
    y = (sample["toxic"].to_numpy() == 1).astype(np.float32)
    if not len(y) or y.min() == y.max():
        return None
    word, grams, from_, inverse, first = words_of(list(sample["text"]))
    size, n1, n0 = 1 << BITS, int(y.sum()), int((1 - y).sum())
    df = {"w": np.zeros((2, size)), "g": np.zeros((2, size))}
    gram_lists = np.split(grams, from_[1:])
    for i, label in enumerate(y.astype(int)):
        own = np.unique(inverse[first[i] : first[i + 1]])
        if len(own):
            df["w"][label][np.unique(word[own])] += 1
            df["g"][label][np.unique(np.concatenate([gram_lists[k] for k in own]))] += 1
    table = lambda less1, less0: [odds(np.maximum(df[k][1] - less1, 0), np.maximum(df[k][0] - less0, 0), n1 - less1, n0 - less0) for k in "wg"]
    full = table(0, 0)
    # each document is trained without its own contribution to the odds
    x = np.stack([inputs(word, grams, from_, *table(0, 1)), inputs(word, grams, from_, *table(1, 0))])
    ids, owner = windows_of(inverse, first)
    label = y[owner].astype(int)
    rng, net = np.random.default_rng(2), Network()
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    evidence = np.where(ids >= 0, x[label[:, None], np.maximum(ids, 0), 0] + x[label[:, None], np.maximum(ids, 0), 1], 0).sum(axis=1)
    step = 0
    for turn in range(ROUNDS):
        order = np.lexsort((-evidence, owner))
        worst = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
        # the worst window of each document, and as many others of documents that are not toxic
        rest = np.flatnonzero(label == 0)
        train = np.concatenate([worst, rng.choice(rest, min(len(rest), n0), replace=False)])
        batch = int(min(BATCH, max(32, len(train) // 4)))
        for _ in range(max(EPOCHS, -(-STEPS * batch // len(train)))):
            rng.shuffle(train)
            for a in range(0, len(train), batch):
                rows = train[a : a + batch]
                t = label[rows].astype(np.float32)
                logit, kept = net.forward(None, ids[rows], x[label[rows][:, None], np.maximum(ids[rows], 0)], keep=True)
                grad = net.backward(kept, ((_sigmoid(logit) - t) / len(rows)).astype(np.float32))
                step += 1
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    net.p[k] -= (RATE / (1 + turn) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        tables = [net.project(x[0]), net.project(x[1])]
        for side in (0, 1):
            for a in range(0, len(own := np.flatnonzero(label == side)), 4096):
                evidence[own[a : a + 4096]] = net.forward(tables[side], ids[own[a : a + 4096]])
    top = np.full(len(y), -1e9)
    np.maximum.at(top, owner, evidence)
    seen = top > -1e8
    a, c = 1.0, 0.0  # calibration of the worst window's logit, by Newton steps with a small ridge
    for _ in range(30):
        p = _sigmoid(a * top[seen] + c)
        e, wt = p - y[seen], p * (1 - p) + 1e-6
        h = np.array([[(wt * top[seen] ** 2).sum() + 1.0, (wt * top[seen]).sum()], [(wt * top[seen]).sum(), wt.sum() + 1e-3]])
        da, dc = np.linalg.solve(h, [(e * top[seen]).sum() + (a - 1.0), e.sum()])
        a, c = max(0.05, a - np.clip(da, -0.5, 0.5)), c - np.clip(dc, -1, 1)
    return {"odds": full, "net": net.p, "a": float(a), "c": float(c), "prior": float(y.mean())}


def score_texts(texts: list[str], model: dict) -> np.ndarray:
    word, grams, from_, inverse, first = words_of(texts)
    ids, owner = windows_of(inverse, first)
    net = Network.__new__(Network)
    net.p = model["net"]
    table = net.project(inputs(word, grams, from_, *model["odds"])) if len(word) else None
    top = np.full(len(texts), -np.inf)
    for a in range(0, len(ids), 4096):
        np.maximum.at(top, owner[a : a + 4096], net.forward(table, ids[a : a + 4096]))
    return np.where(np.isfinite(top), _sigmoid(np.clip(model["a"] * np.where(np.isfinite(top), top, 0) + model["c"], -60, 60)), model["prior"])


def score_documents(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for pdf in chunks(batches, limit=1_000_000):
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            score = score_texts(texts, shared.value) if shared.value else np.zeros(len(texts))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    rows = docs.select("doc_id", "text", (crc_fold("doc_id") == 0).alias("held_out"))
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def predict_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on a bounded sample of the labels outside fold 0, score all rows."""
    return score_documents(docs, fit(sample_labels(docs, labels)))
