"""Sentence boundaries, and annotation in blocks and islands against a plain left-to-right loop."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from vocabrook.functions.stopwords import CORE_STOP_WORDS, ENTITY_STOP_WORDS
from vocabrook.operators import annotation, sentences
from vocabrook.operators.grounding import Grounder
from vocabrook.operators.lexicon_ops import prefix_index
from vocabrook.plans import benchmark_oracles
from vocabrook.sources import lexicon

N = None


def cut(s, known=sentences.NONE):
    return [s[a:z] for a, z in sentences.split_sentences(s, known)]


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("One ends. Two ends! Three?  Four", ["One ends.", "Two ends!", "Three?", "Four"]),
        ("The work of J. Bach is old. It stays.", ["The work of J. Bach is old.", "It stays."]),
        ("See no. 3. of the list. Then 4. Next.", ["See no.", "3. of the list.", "Then 4.", "Next."]),
        ("Wait... what? Yes.", ["Wait... what?", "Yes."]),
        ('He said "Go." (Then he left.) Fine.', ['He said "Go."', "(Then he left.)", "Fine."]),
        ("p53 rose by 3.5 percent. EGF binds EGFR: a receptor.", ["p53 rose by 3.5 percent.", "EGF binds EGFR: a receptor."]),
        ("  \n ", []), ("", []), ("no stop at all", ["no stop at all"]), ("a.b.c is one. x", ["a.b.c is one.", "x"]),
    ],
)
def test_sentences(text, parts):
    assert cut(text) == parts


def test_what_is_known_of_words():
    known = sentences.Boundaries(frozenset(["dr", "e.g", "fig"]), frozenset(["the"]), frozenset([("#", "chapter"), ("v", "cells")]))
    assert cut("Ask Dr. Smith e.g. about Fig. 2 now. Well", known) == ["Ask Dr. Smith e.g. about Fig. 2 now.", "Well"]
    assert cut("It was (Fig. The next one came. So", known) == ["It was (Fig.", "The next one came.", "So"]
    assert cut("In 3. Chapter one. End... The rest", known) == ["In 3. Chapter one.", "End...", "The rest"]


CORPUS = ["We saw dr. Smith today. The day was fine.", "Then dr. Miller came, e.g. by bus. The bus was late.", "Ask dr. Jones. The rest can wait.", "The bus and the day went. A dog ran.", "It is fine if late today, they ran or went or must wait and can smith or jones it"] * 12


def test_abbreviations_are_learnt(spark):
    docs = spark.createDataFrame([(t,) for t in [*CORPUS, "", N]], "text string")
    known = sentences.learned(docs)
    assert {"dr", "e.g"} <= known.abbreviations and not {"today", "late", "smith", "jones"} & known.abbreviations
    assert "the" in known.starters
    assert cut(CORPUS[0], known) == ["We saw dr. Smith today.", "The day was fine."] and cut(CORPUS[0])[0] == "We saw dr."
    assert sentences.boundary_statistics(docs.limit(0)).count() == 0


def test_abbreviation_scores_against_sql(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*CORPUS, 'A "quote." (See fig. 2.) U.S. 3.5. ends...', N])], "doc_id int, text string")
    con = duckdb.connect()
    con.register("documents_rows", docs.toArrow())
    con.execute("CREATE VIEW documents AS SELECT * FROM documents_rows")
    want = {(a, b, c): d for a, b, c, d in con.execute(f"SELECT word, with_stop, without, score FROM ({benchmark_oracles.sql()['abbreviation_scores']})").fetchall()}
    got = {(r.word, r.with_stop, r.without): r.score for r in sentences.abbreviation_scores(sentences.words(docs)).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in got)


# ---- tokens


def by_substitution(text):
    """The convention's published rules, one substitution after the other; tokens are what spaces separate then."""
    t = re.sub(r'^"', "`` ", text.rstrip("."))
    for rule, to in (
        (r'([ (\[{<])"', r"\1 `` "), (r"([:,])(?=[^\d])", r" \1 "), (r"([:,])$", r" \1 "), (r"\.\.\.", " ... "), (r"[;@#$%&]", r" \g<0> "), (r"([^.])(\.)([\])}>\"']*)\s*$", r"\1 \2\3 "), (r"[?!]", r" \g<0> "),
        (r"([^'])' ", r"\1 ' "), (r"[\]\[(){}<>]", r" \g<0> "), ("--", " -- "), ("^|$", " "), ("''", " '' "), ('"', " '' "), (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
        (r"(?i)\b(can)(not)\b", r" \1 \2 "), (r"(?i)\b(gim|lem)(me)\b", r" \1 \2 "), (r"(?i)\b(gon|wan)(na)\b(?=\s)", r" \1 \2 "), (r"(?i)\b(got)(ta)\b", r" \1 \2 "), (r"(?i)\b(more)('n)\b", r" \1 \2 "), (r"(?i)\s('t)(is|was)\b", r" \1 \2 "),
    ):
        t = re.sub(rule, to, t)
    return ['"' if x in ("``", "''") else x for x in t.split()]


def tokens(s):
    return ['"' if s[a:z] == "''" else s[a:z] for a, z in annotation.tokenize(s)]


def test_tokens_against_the_rules():
    words = "E. coli can't John's 3,000 a:b (x) e.g. don't cannot T-cell p53/MDM2 he'll -- ... 50% A&B it, so; end. dogs' wanna [1] <sub> 5:3 'quoted U.S. x@y why? n't WE'VE \"hi\" \" gimme 'tis more'n IL-2's".split()
    rnd = random.Random(1)
    for _ in range(4000):
        s = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 10)))
        assert tokens(s) == by_substitution(s), s
    assert tokens("E. coli grows (in vitro).") == ["E.", "coli", "grows", "(", "in", "vitro", ")"]


def test_a_name_with_an_inner_stop_is_found(spark):
    rows = [("e. coli", "E. coli", "T", "1", "E. coli", "name", "t", N, N, N)]
    g = Grounder(spark, spark.createDataFrame(rows, lexicon.TERMS))
    docs = spark.createDataFrame([(1, "Strains of E. coli grow. Others of E. coli.")], "id int, text string")
    assert sorted((r.start, r.raw) for r in annotation.annotate(docs, g).collect()) == [(11, "E. coli"), (35, "E. coli")]


# ---- annotation


def plain(text, entries, split):
    """Left to right, longest span first, as an interpreter would do it."""
    out = []
    lengths = {}
    for e in entries:
        lengths.setdefault(e.split()[0], set()).add(len(e.split()))
    for a, z in split(text):
        sentence = text[a:z]
        at = annotation.tokenize(sentence)
        words = [sentence[x:y].lower() for x, y in at]
        skip = 0
        for i, w in enumerate(words):
            if i < skip or w in CORE_STOP_WORDS:
                continue
            for n in sorted((n for n in lengths.get(w, ()) if i + n <= len(words)), reverse=True):
                raw = sentence[at[i][0] : at[i + n - 1][1]]
                if (n == 1 and w in {*CORE_STOP_WORDS, *ENTITY_STOP_WORDS}) or len(raw) <= 1 or " ".join(raw.split()).lower() not in entries:
                    continue
                out.append((a + at[i][0], a + at[i + n - 1][1], raw))
                skip = i + n
                break
    return out


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "omega", "cell", "death", "zeta"]
    entries = {" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 4))) for _ in range(40)}
    rows = [(e, e, "X", str(k), e, "name", "x", N, N, N) for k, e in enumerate(sorted(entries))]
    texts = [" ".join(rnd.choice([*vocabulary, "the", "xx", "beta.", "A."]) for _ in range(rnd.randint(0, 120))) for _ in range(40)]
    return Grounder(spark, spark.createDataFrame(rows, lexicon.TERMS)), entries, [*texts, "", N]


@pytest.mark.parametrize("block", [2, 7, 256])
def test_blocks_and_islands_choose_as_a_loop_does(spark, world, monkeypatch, block):
    monkeypatch.setattr(annotation, "BLOCK", block)
    grounder, entries, texts = world
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in annotation.annotate(docs, grounder).collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.raw))
        assert r.curie and r.matches[0].rank == 1
    for k, t in enumerate(texts):
        assert sorted(got.get(k, [])) == plain(t or "", entries, sentences.split_sentences), t


def test_a_text_without_full_stops_stays_in_bounded_rows(spark, world):
    grounder, entries, _ = world
    text = "alpha beta xx gamma delta cell death " * 30_000  # over a megabyte, one sentence
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    rows = annotation.tokens(docs, "text", "id")
    spans = annotation.candidates(rows, prefix_index(grounder.terms))
    sizes = annotation.islands(spans.filter(F.col("raw").isin(*entries))).groupBy("island").count().agg(F.max("count")).first()[0]
    assert sizes < 40
    assert spans.select("idx", "span").distinct().count() == spans.count() > 100_000
