"""Operators without SQL against plain versions: a tree walk for pages, scalar loops for the network, subsets for mixtures."""

import html
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocabrook.llm import html_extract, lang_mixture, toxicity

# ---- op1

BLOCKS = {"p", "div", "section", "h2", "h3", "ul", "li", "table", "tr", "td", "article", "blockquote"}


def build(rnd, depth=0):
    """A random piece of an article: (tag, attributes, children), children are pieces or texts."""
    text = lambda: " ".join(rnd.choice(["alpha", "b&c", "näh", "x<y", "  spaced ", "word"]) for _ in range(rnd.randint(1, 6)))
    kind = rnd.choice(["p", "p", "h2", "div", "section", "ul", "table", "blockquote", "drop"] if depth < 3 else ["p", "h3"])
    names = rnd.choice(["", "", " class='section-header'", " id='related'", " class='topic-social x'", ' title="a > b"', " data-x=1 hidden2"])
    if kind == "drop":
        tag, attrs = rnd.choice([("div", " class='comments'"), ("div", " class=ad-slot"), ("aside", ""), ("form", ""), ("ul", " class='main-nav'"), ("script", ""), ("div", " style='display: none'")])
        return tag, attrs, [text().replace("<", "&lt;") if tag == "script" else text()], True
    if kind in ("p", "h2", "h3"):
        return kind, names, [text(), ("span", " class='ui-menu'", [text()], False), text()] if rnd.random() < 0.4 else [text()], False
    if kind == "ul":
        return "ul", "", [("li", rnd.choice(["", " class=header"]), [text()], False) for _ in range(rnd.randint(1, 3))], False
    if kind == "table":
        return "table", "", [("tr", " class='header'", [("td", "", [text()], False), ("td", "", [text()], False)], False)], False
    return kind, names, [build(rnd, depth + 1) for _ in range(rnd.randint(1, 3))], False


def source(piece):
    if isinstance(piece, str):
        return html.escape(piece, quote=False)
    tag, attrs, children, _ = piece
    return f"<{tag}{attrs}>{''.join(map(source, children))}</{tag}>"


def blocks(piece):
    """The walk: texts, None at the borders of blocks, nothing below what is dropped."""
    if isinstance(piece, str):
        return [piece]
    tag, _, children, dropped = piece
    inner = [] if dropped else [x for c in children for x in blocks(c)]
    return [None, *inner, None] if tag in BLOCKS or dropped and tag != "script" else inner


def walked(pieces):
    out, now = [], []
    for x in [*pieces, None]:
        if x is None:
            out.append(" ".join("".join(now).split()))
            now = []
        else:
            now.append(x)
    return "\n".join(b for b in out if b)


@pytest.mark.parametrize("seed", range(40))
def test_pages_against_a_tree_walk(seed):
    rnd = random.Random(seed)
    article = ("article", rnd.choice(["", " class='post sidebar-none'"]), [("h2", " id='search'", ["Title here"], False), ("p", "", ["Long enough text of the article. " * 5], False), *[build(rnd) for _ in range(6)], ("p", "", [("a", " href=x", ["read more"], False)], False)], False)
    page = f"<!doctype html><html><head><title>no</title></head><body class='has-sidebar'><nav>menu</nav><div id='sidebar'>side</div>{source(article)}<footer>foot</footer></body></html>"
    assert html_extract.extract(page, [])[0] == walked(blocks(article))


def test_probed_pages():
    body = f"<p>{'Some good words here. ' * 10}</p>"
    read = lambda x: html_extract.extract(f"<html><body><nav>menu</nav>{x.replace('BODY', body)}<footer>foot</footer></body></html>", [])[0].replace(" ".join(("Some good words here. " * 10).split()), "BODY")
    want = {
        "<article><h2 class='section-header'>M</h2>BODY</article>": "M\nBODY", "<article><table><tr class='header'><td>H</td></tr></table>BODY</article>": "H\nBODY",
        "<article><h2 id='search'>S</h2><h3 id='Comments'>C</h3>BODY</article>": "S\nC\nBODY", "<article><section id='social'><p>x</p></section>BODY</article>": "x\nBODY",
        "<article><div class='topic-social'>x</div><p class='job-search'>y</p>BODY</article>": "x\ny\nBODY", "<article><p>in <span class='ui-menu'>it</span></p>BODY</article>": "in it\nBODY",
        "<div class=post><div class=body>BODY</div><p><a href=x>Paper</a></p></div>": "BODY\nPaper", "<div class=post><div class=body>BODY</div><ul><li><a href=x>Link</a></li></ul></div>": "BODY",
        f"<article><p title='{'x' * 2000}>LEAK'>ok</p>BODY</article>": "ok\nBODY", f"<article><p {' '.join(f'a{i}=1' for i in range(70))}>many</p>BODY</article>": "many\nBODY",
        "<article>BODY<div id='comments'>spam</div></article>": "BODY", "<div id='header'>site</div><article>BODY</article>": "BODY", "<article><p don't>a</p>BODY</article>": "a\nBODY",
        '<article>BODY</article><p class="x>never closed': "BODY\n",
    }
    for page, text in want.items():
        assert read(page).startswith(text) if text.endswith("\n") else read(page) == text, page


def test_scanner_is_linear():
    import time

    began = time.time()
    for bad in ('<a x=">' * 40_000 + '"', "<a x='" * 40_000 + ">", "<p title=" * 40_000 + ">", '<p a="' + "y" * 300_000 + ">" * 3, "<script" * 40_000 + ">", "<!--" * 40_000):
        list(html_extract.tags(bad))
        html_extract.extract(f"<html><body><p>good</p>{bad}", [])
    assert time.time() - began < 30


# ---- op2


def plain_logit(net, x):
    """One window of inputs (words, INPUTS), word by word and unit by unit."""
    p, h = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    sig = lambda v: 1 / (1 + math.exp(-v))
    both = []
    for d in "fb":
        state, states = [0.0] * h, []
        for row in x if d == "f" else x[::-1]:
            a = [sum(row[i] * p[d + "W"][i, j] for i in range(len(row))) + p[d + "c"][j] for j in range(3 * h)]
            b = [sum(state[i] * p[d + "U"][i, j] for i in range(h)) for j in range(3 * h)]
            z, r = [sig(a[j] + b[j]) for j in range(h)], [sig(a[h + j] + b[h + j]) for j in range(h)]
            c = [math.tanh(a[2 * h + j] + r[j] * b[2 * h + j]) for j in range(h)]
            state = [z[j] * state[j] + (1 - z[j]) * c[j] for j in range(h)]
            states.append(state)
        both.append(states if d == "f" else states[::-1])
    s = [f + b for f, b in zip(*both, strict=True)]
    e = [math.exp(sum(v * w for v, w in zip(t, p["v"], strict=True))) for t in s]
    pooled = [sum(e[t] * s[t][j] for t in range(len(s))) / sum(e) for j in range(2 * h)]
    return sum(a * b for a, b in zip(pooled, p["w"], strict=True)) + p["bias"][0]


@pytest.fixture(scope="module")
def windows():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (5, 12, toxicity.INPUTS)).astype(np.float32)
    ids = np.zeros((5, 12), np.int64)
    for i, n in enumerate((12, 7, 1, 3, 12)):
        ids[i, n:] = -1
    return toxicity.Network(4), ids, x


def test_network_against_scalar_loops(windows):
    net, ids, x = windows
    got = net.forward(None, ids, x)
    for i in range(len(ids)):
        assert abs(got[i] - plain_logit(net, x[i, ids[i] >= 0].astype(float))) < 1e-4


def test_gradients_against_differences(windows):
    net, ids, x = windows
    weight = np.array([1.0, -0.5, 2.0, 0.3, -1.0], np.float32)
    _, kept = net.forward(None, ids, x, keep=True)
    grad, rng = net.backward(kept, weight), np.random.default_rng(5)
    for name, value in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            old, eps = value[at], 1e-2
            value[at] = old + eps
            up = float(weight @ net.forward(None, ids, x))
            value[at] = old - eps
            down = float(weight @ net.forward(None, ids, x))
            value[at] = old
            assert abs((up - down) / (2 * eps) - grad[name][at]) < 5e-3 * max(1, abs(grad[name][at])), (name, at)


def test_windows_cover_every_word():
    rnd = random.Random(1)
    texts = [" ".join("w%d" % rnd.randint(0, 50) for _ in range(n)) for n in (0, 1, 31, 32, 33, 48, 49, 500)]
    _, _, _, inverse, first = toxicity.words_of(texts)
    ids, owner = toxicity.windows_of(inverse, first)
    for i in range(len(texts)):
        own = inverse[first[i] : first[i + 1]]
        mine = ids[owner == i]
        assert len(mine) == (0 if not len(own) else max(1, -(-(len(own) - toxicity.WINDOW) // toxicity.STRIDE) + 1))
        again = {k * toxicity.STRIDE + j: w for k, row in enumerate(mine) for j, w in enumerate(row) if w >= 0}
        assert [again[k] for k in range(len(own))] == list(own)


def test_toxicity_of_odd_rows(spark):
    rnd = random.Random(6)
    word = lambda bad: rnd.choice(["vile", "awful", "hatred"] if bad else ["calm", "green", "river", "stone"])
    rows = [(k, " ".join(word(k % 4 == 0 and rnd.random() < 0.5) for _ in range(40)), "x", 1) for k in range(200)]
    rows += [(500, "calm " * 200_000 + "vile awful hatred " * 20, "x", 1), (501, N, "x", 1), (501, N, "x", 1), (None, "calm", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, held_out int")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int")
    got = toxicity.predict_toxicity(docs, labels).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    right = [(by[k] >= 0.5) == (k % 4 == 0) for k in range(200)]
    assert sum(right) > 190 and by[500] > 0.5 > by[None]  # what a very long text says at its end counts
    assert toxicity.predict_toxicity(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0


N = None

# ---- op3


def plain_em(lik, pi, steps):
    for _ in range(steps):
        share = [0.0] * len(pi)
        for row in lik:
            total = sum(a * b for a, b in zip(row, pi, strict=True))
            share = [s + a * b / total for s, a, b in zip(share, row, pi, strict=True)]
        pi = [s / len(lik) for s in share]
    return pi, sum(math.log(sum(a * b for a, b in zip(row, pi, strict=True))) for row in lik)


def test_mixture_against_plain_em():
    rng = np.random.default_rng(2)
    first, lik = np.array([0, 5, 5, 30]), rng.random((30, 4)) + 1e-3
    pi, fit = lang_mixture._em(lik, first, np.full((3, 4), 0.25), 6)
    for k, (a, z) in enumerate(itertools.pairwise(first)):
        if z > a:
            want, value = plain_em(lik[a:z].tolist(), [0.25] * 4, 6)
            assert np.allclose(pi[k], want) and abs(fit[k] - value) < 1e-9


def test_chosen_sets_against_all_sets():
    """The penalised likelihood of the chosen set is that of the best of all sets, fitted to the end."""
    rnd = random.Random(5)
    parts, names = ("aeiou", "klmnz", "bcdfg", "rstvw"), ["p", "q", "r", "s"]
    word = lambda a: "".join(rnd.choice(a) for _ in range(rnd.randint(3, 7)))
    tables = []
    for a in parts:
        grams, *_ = lang_mixture._trigrams([" ".join(word(a) for _ in range(3000))])
        c = np.bincount(grams, minlength=1 << lang_mixture.TABLE_BITS) + lang_mixture.SMOOTH
        tables.append(np.log(c / c.sum()).astype(np.float32))
    tables = np.stack(tables)
    for mixed in ((0,), (1, 2), (0, 1, 3), (0, 1, 2, 3)):
        text = " ".join(word(parts[k]) for k in mixed for _ in range(25))
        ((best, _, shares, _),) = lang_mixture.infer([text], names, tables)
        grams, starts, ends, _ = lang_mixture._trigrams([text])
        logs = np.array([[tables[k][grams[s - 1 : e - 1]].sum() for k in range(4)] for s, e in zip(starts, ends, strict=True)])
        lik = np.exp(logs - logs.max(axis=1, keepdims=True))
        scores = {}
        for m in range(1, 5):
            for chosen in itertools.combinations(range(4), m):
                _, fit = plain_em(np.maximum(lik[:, chosen], 1e-12).tolist(), [1 / m] * m, 30)
                scores[chosen] = fit - lang_mixture.PENALTY * 0.5 * (m - 1) * math.log(len(starts) + 1)
        assert tuple(sorted(names.index(x) for x in shares)) == max(scores, key=scores.get) == mixed
        assert best in shares


def test_languages_of_odd_rows(spark):
    rnd = random.Random(9)
    word = lambda a: "".join(rnd.choice(a) for _ in range(5))
    rows = [(k, " ".join(word("aeiou" if k % 2 else "klmnz") for _ in range(30)), "v" if k % 2 else "c", "x", 1.0) for k in range(80)]
    rows += [(200, " ".join(word("aeiou") for _ in range(100_000)), N, "x", 1.0), (201, "", N, "x", 1.0), (201, "", N, "x", 1.0), (N, "  12 ", "v", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = lang_mixture.predict_languages(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.lang_pred) for r in got} == {(r[0], r[2] if r[0] is not None and r[0] < 80 else "v" if r[0] == 200 else "und") for r in rows}
