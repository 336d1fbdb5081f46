"""Sentence boundaries: a full stop ends a sentence unless it belongs to an abbreviation, an initial, a number or an ellipsis.

Abbreviations are learnt without labels, from how often a word stands with a full stop and without one: a likelihood ratio
against a word that always has one, weighted for short words and inner stops. Words that often begin sentences, and words that
often follow a numeral or an initial, are learnt by the ratio of a pair. All counts are aggregations over the whole corpus;
what the splitter needs of them, the words above the thresholds, is collected behind a check of its number.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import reused

#: Least scores of an abbreviation, a sentence starter and a pair.
ABBREVIATION, STARTER, PAIR = 0.3, 30.0, 7.88
#: At most so many learnt words are taken to the workers; more are an error, not a cut.
MOST = 100_000

CANDIDATE = re.compile(r"[.?!]+[\"'’”)\]}]*(?=\s)")
_OPENING, _CLOSING = "\"'‘“([{", "\"'’”)]},;:?!"
_NUMBER = re.compile(r"-?\d+(?:[.,]\d+)*\.?$")
_INITIAL = re.compile(r"[^\W\d_]\.$")


@dataclass
class Boundaries:
    """What is known of words, in lower case and without their last full stop; nothing by default."""

    abbreviations: frozenset = field(default_factory=frozenset)
    starters: frozenset = field(default_factory=frozenset)
    pairs: frozenset = field(default_factory=frozenset)

    def ends(self, word: str, following: str) -> bool:
        """Whether a sentence ends behind word, which has a full stop or another sign at its end, before following."""
        bare = word.strip(_OPENING + "\"'’”)]}")
        if not bare.endswith("."):
            return True
        after = following.lstrip(_OPENING).rstrip(_CLOSING + ".")
        name, begins = bare[:-1].lower(), after[:1].isupper() and after.lower() in self.starters
        if re.search(r"\.\.+$", bare):
            return begins
        number, initial = bool(_NUMBER.match(bare)), bool(_INITIAL.match(bare))
        if (number or initial) and (("#" if number else name), after.lower()) in self.pairs:
            return False
        if initial:
            # an initial goes with the name behind it
            return begins or not after[:1].isalpha()
        if number:
            return not after[:1].islower()
        return name not in self.abbreviations or begins


NONE = Boundaries()


def split_sentences(s: str, known: Boundaries = NONE) -> list[tuple[int, int]]:
    """Half-open spans of the sentences, without white space around them; closing quotes and brackets go with a sentence."""
    out, begin = [], 0
    for m in CANDIDATE.finditer(s):
        at = m.start()
        while at > begin and not s[at - 1].isspace():
            at -= 1
        following = s[m.end() : m.end() + 200].split(None, 1)
        if not following or not known.ends(s[at : m.end()], following[0]):
            continue
        out.append((begin, m.end()))
        begin = m.end()
    out.append((begin, len(s)))
    spans = []
    for a, z in out:
        piece = s[a:z]
        a += len(piece) - len(piece.lstrip())
        z -= len(piece) - len(piece.rstrip())
        if a < z:
            spans.append((a, z))
    return spans


# ---- what the corpus tells


def words(docs: DataFrame, column: str = "text") -> DataFrame:
    """word, stop, next: each token in lower case without quotes and signs around it, whether it had a full stop, and the one behind it.

    Numbers are all '#'. Ellipses are no words with a full stop.
    """
    text = F.regexp_extract_all(F.lower(column), F.lit(r"\S+"), F.lit(0))
    bare = F.transform(text, lambda t: F.regexp_replace(t, "^[\"'(\\[{]+|[\"')\\]},;:?!]+$", ""))
    named = F.filter(bare, lambda t: t.rlike(r"[\p{L}\p{N}]"))
    mark = lambda t: F.when(t.rlike(r"^-?[0-9]+([.,][0-9]+)*\.?$"), F.concat(F.lit("#"), F.when(t.endswith("."), ".").otherwise(""))).otherwise(t)
    marked = F.transform(named, mark)
    following = F.concat(F.slice(marked, F.lit(2), F.greatest(F.size(marked) - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
    rows = docs.filter(F.col(column).isNotNull()).select(F.explode(F.arrays_zip(marked.alias("a"), following.alias("b"))).alias("x")).filter("x.a is not null")
    stop = F.col("x.a").endswith(".") & ~F.col("x.a").endswith("..")
    return rows.select(F.when(stop, F.regexp_replace("x.a", r"\.$", "")).otherwise(F.col("x.a")).alias("word"), stop.alias("stop"), F.regexp_replace("x.b", r"\.+$", "").alias("next"))


#: The same in plain Python. A line's end at the end of a token, which is no white space there, is stepped over.
_END = r"(?=[\x85\u2028\u2029]?\Z)"
_TOKEN, _SIGNS = re.compile(r"[^ \t\n\x0b\f\r]+"), re.compile("\\A[\"'(\\[{]+|[\"')\\]},;:?!]+" + _END)
_FIGURES, _STOPS = re.compile(r"-?[0-9]+([.,][0-9]+)*\.?" + _END), re.compile(r"\.+" + _END)
#: Tokens that a task remembers, and counts that it holds.
SEEN, HELD = 1 << 18, 1 << 19


def marked(token: str) -> tuple[str, bool, str] | None:
    """Of a token in lower case: its word, whether it has a full stop, and what it is as the next one; None if it is no word."""
    t = _SIGNS.sub("", token)
    if not any(c.isalnum() if c < "\x80" else unicodedata.category(c)[0] in "LN" for c in t):
        return None
    if _FIGURES.match(t):
        t = "#." if t.endswith(".") else "#"
    stop = t.endswith(".") and not t.endswith("..")
    return t[:-1] if stop else t, stop, _STOPS.sub("", t)


def word_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """word, next, with_stop, without: how often words() has a word (next is null), and a word with a full stop before next.

    Counted where the texts are read; only sums are exchanged.
    """

    def counted(batches):
        known, words, pairs = {}, Counter(), Counter()

        def sums():
            rows = [(w, None, n if stop else 0, 0 if stop else n) for (w, stop), n in words.items()] + [(w, after, n, 0) for (w, after), n in pairs.items()]
            words.clear()
            pairs.clear()
            return pd.DataFrame(rows, columns=["word", "next", "with_stop", "without"])

        for pdf in batches:
            for text in pdf["text"]:
                tokens = _TOKEN.findall(text)
                for t in set(tokens).difference(known):
                    known[t] = marked(t)
                row = [x for t in tokens if (x := known[t])]
                words.update((w, stop) for w, stop, _ in row)
                pairs.update((x[0], y[2]) for x, y in zip(row, row[1:]) if x[1])  # noqa: B905
                if len(known) > SEEN:
                    known.clear()
                if len(words) + len(pairs) > HELD:
                    yield sums()
        yield sums()

    rows = docs.select(F.lower(column).alias("text")).filter("text is not null").mapInPandas(counted, "word string, next string, with_stop long, without long")
    return rows.groupBy("word", "next").agg(F.sum("with_stop").alias("with_stop"), F.sum("without").alias("without"))


def _times_log(n: Column, p: Column) -> Column:
    """n * log(p), 0 where n is 0."""
    return F.when(n > 0, n * F.log(p)).otherwise(0.0)


def pair_ratio(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Twice the log likelihood ratio of `both` of a words being followed by one of the b, against chance among n."""
    p, p1, p2 = b / n, both / a, (b - both) / (n - a)
    rest_a, rest_b, none = a - both, b - both, n - a - b + both
    alone = _times_log(both, p) + _times_log(rest_a, 1 - p) + _times_log(rest_b, p) + _times_log(none, 1 - p)
    bound = _times_log(both, p1) + _times_log(rest_a, 1 - p1) + _times_log(rest_b, p2) + _times_log(none, 1 - p2)
    return 2 * (bound - alone)


def abbreviation_scores(counted: DataFrame) -> DataFrame:
    """words() -> word, with_stop, without, score of all words with a letter that have a full stop somewhere."""
    return scored(counted.groupBy("word").agg(F.count_if("stop").alias("with_stop"), F.count_if(~F.col("stop")).alias("without")))


def scored(by_word: DataFrame) -> DataFrame:
    """word, with_stop, without of all words -> abbreviation_scores()."""
    sums = by_word.agg(F.sum(F.col("with_stop") + F.col("without")).alias("n"), F.sum("with_stop").alias("stops"))
    rows = by_word.filter("with_stop > 0").filter(F.col("word").rlike(r"\p{L}")).join(F.broadcast(sums))
    p, w, o = F.col("stops") / F.col("n"), F.col("with_stop"), F.col("without")
    ratio = 2 * (_times_log(w, F.lit(0.99)) + _times_log(o, F.lit(0.01)) - _times_log(w, p) - _times_log(o, 1 - p))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - inner
    return rows.select("word", "with_stop", "without", (ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -o)).alias("score"))


def boundary_statistics(docs: DataFrame, column: str = "text") -> DataFrame:
    """kind ('abbreviation', 'starter' or 'pair'), word, next, score: all above their thresholds."""
    counts = reused(word_counts(docs, column))
    by_word = counts.filter("next is null").select("word", "with_stop", "without")
    short = scored(by_word).filter(F.col("score") >= ABBREVIATION).select("word", "score")
    single = F.col("word") == F.regexp_extract("word", r"^\p{L}$", 0)
    pairs = counts.filter("next is not null").select("word", "next", F.col("with_stop").alias("both"))
    totals = by_word.select("word", (F.col("with_stop") + F.col("without")).alias("total"))
    n = totals.agg(F.sum("total").alias("n"))
    breaks = pairs.filter("word <> '#'").filter(~single).join(short.select("word"), "word", "left_anti")
    starts = breaks.groupBy("next").agg(F.sum("both").alias("both"))
    known = totals.select(F.col("word").alias("next"), F.col("total").alias("b"))
    starts = starts.join(F.broadcast(breaks.agg(F.sum("both").alias("a")))).join(known, "next").join(F.broadcast(n))
    c = F.col
    starts = starts.withColumn("score", pair_ratio(c("a"), c("b"), c("both"), c("n"))).filter((c("score") >= STARTER) & (c("both") * c("n") > c("a") * c("b")) & c("next").rlike(r"^\p{L}"))
    bound = pairs.filter("both > 1").filter((F.col("word") == "#") | single).join(totals.withColumnRenamed("total", "a"), "word").join(known, "next").join(F.broadcast(n))
    bound = bound.withColumn("score", pair_ratio(c("a"), c("b"), c("both"), c("n"))).filter((c("score") >= PAIR) & (c("both") * c("n") > c("a") * c("b")))
    none = F.lit(None).cast("string")
    return (
        short.select(F.lit("abbreviation").alias("kind"), "word", none.alias("next"), "score")
        .unionByName(starts.select(F.lit("starter").alias("kind"), none.alias("word"), "next", "score"))
        .unionByName(bound.select(F.lit("pair").alias("kind"), "word", "next", "score"))
    )


def learned(docs: DataFrame, column: str = "text") -> Boundaries:
    """The boundaries that a corpus tells; split_sentences takes them, and annotate(boundaries=..)."""
    rows = boundary_statistics(docs, column).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} words are above the thresholds")
    of = lambda kind: (r for r in rows if r.kind == kind)
    return Boundaries(frozenset(r.word for r in of("abbreviation")), frozenset(r.next for r in of("starter")), frozenset((r.word, r.next) for r in of("pair")))
