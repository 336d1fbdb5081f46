"""Dictionary annotation of documents: sentences, tokens, candidate spans, grounding, greedy selection, renderings.

A document's spans are one row of packed numbers, and only their distinct strings are grounded (found_spans). With context
models, or a lexicon of which not all tasks can be told, tokens and spans are rows instead: tokens come from one pass over
the text, a slim row each; everything behind is joins and aggregations. The prefix index is the right side of an outer join
there, so Spark may broadcast the index if it is small, but never the tokens. A span's text is put together from its tokens,
after the index has found its first one. Distinct span texts are grounded once, and the leftmost-longest choice is made per
sentence afterwards. Both ways give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import curie, text
from ..functions.stopwords import CORE_STOP_WORDS, ENTITY_STOP_WORDS
from ..sources.tables import reused
from .found_spans import found_spans, told
from .grounding import Grounder, context_key
from .lexicon_ops import prefix_index
from .sentences import NONE, Boundaries, split_sentences

#: The Penn Treebank convention. Signs that are tokens of their own; a comma or colon is one unless a digit follows.
APART = re.compile(r"[:,](?!\d)|\.\.\.|[;@#$%&?!]|[\]\[(){}<>]|--|''|\"")
#: A full stop before nothing but closing signs; a quotation mark at a word's end; endings that are cut off; words that are two.
LAST_STOP = re.compile(r"(?<=[^.])\.(?=[\])}>\"']*\s*\Z)")
ENDING = re.compile(r"(?<=[^'\s])(?:'(?:[sSmMdD]|ll|LL|re|RE|ve|VE)?|n't|N'T)")
TWO = re.compile(r"\b(can)(not)\b|\b(d)('ye)\b|\b(gim)(me)\b|\b(gon)(na)\b|\b(got)(ta)\b|\b(lem)(me)\b|\b(more)('n)\b|\b(wan)(na)(?=\s|\Z)|(?:(?<=\s)|\A)('t)(is|was)\b", re.I)
#: Tokens of a sentence that come together in one row.
BLOCK = 256


#: Words without other signs that are two tokens; pieces of words seen before, up to so many.
JOINED = frozenset("cannot gimme gonna gotta lemme wanna".split())
SEEN, _pieces_of = 1 << 16, {}


def pieces(word: str, last: bool) -> tuple[tuple[int, int], ...]:
    """Spans of the tokens of what stands between white space; last: nothing follows in the sentence."""
    cuts = {x for m in APART.finditer(word) for x in m.span()}
    if last:
        cuts |= {x for m in LAST_STOP.finditer(word) for x in m.span()}
    ends = lambda k: k == len(word) or k in cuts
    cuts |= {x for m in ENDING.finditer(word) if ends(m.end()) for x in m.span()}
    cuts |= {m.end(k) for m in TWO.finditer(word) for k in range(1, 18, 2) if m[k]}
    at = [0, *sorted(c for c in cuts if 0 < c < len(word)), len(word)]
    return tuple(zip(at[:-1], at[1:], strict=True))


def tokenize(sentence: str) -> list[tuple[int, int]]:
    """Spans of the tokens of a sentence without its closing dots.

    A word keeps a full stop inside the sentence ('E. coli'), inner dots, dashes and slashes; its signs and endings are cut off.
    """
    s, out = sentence.rstrip("."), []
    end = len(s.rstrip())
    for m in re.finditer(r"\S+", s):
        word = m[0]
        if word.isalnum() and word.lower() not in JOINED:
            out.append(m.span())
            continue
        key = (word, m.end() == end)
        found = _pieces_of.get(key)
        if found is None:
            if len(_pieces_of) >= SEEN:
                _pieces_of.clear()
            found = _pieces_of[key] = pieces(*key)
        a = m.start()
        out += [(a + x, a + z) for x, z in found]
    return out


def cutters(split: Callable[[str], list[tuple[int, int]]] | None = None, simple: bool = False, boundaries: Boundaries = NONE) -> tuple[Callable, Callable]:
    """What gives the spans of a text's sentences, and those of a sentence's tokens."""
    spans_of = split or (lambda s: [m.span() for m in re.finditer(r"[^\n]+", s)] if simple else split_sentences(s, boundaries))
    return spans_of, (lambda s: [m.span() for m in re.finditer(r"[^\W\d_]+", s)]) if simple else tokenize


def tokens(docs: DataFrame, column: str, id_: str, split: Callable[[str], list[tuple[int, int]]] | None = None, simple: bool = False, boundaries: Boundaries = NONE) -> DataFrame:
    """id, sent, idx, start, token, word (the normalised token), in order of the text. boundaries: what sentences.learned() told.

    simple: a sentence is a line and a token a run of letters; for checks against other engines.
    """
    spans_of, pieces = cutters(split, simple, boundaries)

    def cut(batches):
        for pdf in batches:
            number, sent, idx, start, found = [], [], [], [], []
            for n, s in enumerate(pdf["text"]):
                for k, (a, z) in enumerate(spans_of(s) if isinstance(s, str) and s else ()):
                    at = pieces(s[a:z])
                    number += [n] * len(at)
                    sent += [k] * len(at)
                    idx += range(len(at))
                    start += [a + x for x, _ in at]
                    found += [s[a + x : a + y] for x, y in at]
            if number:
                yield pd.DataFrame({"id": pdf["id"].iloc[number].array, "sent": sent, "idx": idx, "start": start, "token": found})

    rows = docs.select(F.col(id_).alias("id"), F.col(column).alias("text"))
    rows = rows.mapInPandas(cut, f"id {rows.schema['id'].dataType.simpleString()}, sent int, idx int, start int, token string")
    return rows.withColumn("word", text.normalize("token"))


def _span_text(parts: Column) -> Column:
    """The tokens of a span, with as many spaces between two as there are characters."""
    end = lambda x: x["start"] + F.length(x["token"])
    gaps = F.transform(parts, lambda x, i: F.concat(F.repeat(F.lit(" "), F.when(i > 0, x["start"] - end(F.get(parts, i - 1))).otherwise(0)), x["token"]))
    return F.array_join(gaps, "")


def candidates(rows: DataFrame, index: DataFrame, stop_words: Sequence[str] = ENTITY_STOP_WORDS, core: Sequence[str] = CORE_STOP_WORDS) -> DataFrame:
    """id, sent, idx, span, start, end, raw: the spans whose first word begins a lexicon entry of that many words."""
    first = F.when(~F.col("word").isin(*core), F.col("word"))
    alone = F.col("word").isin(*stop_words)
    rows = rows.withColumn("first", first).join(index.withColumnRenamed("first_word", "first"), "first", "left")
    lengths = F.when(alone, F.filter("lengths", lambda n: n > 1)).otherwise(F.col("lengths"))
    # a sentence is worked on in blocks of BLOCK tokens and those that the longest span from a block's last one reaches
    reach = index.agg(F.coalesce(F.max(F.array_max("lengths")), F.lit(1)).alias("n")).scalar()
    blocks = F.sequence(F.floor(F.greatest(F.col("idx") - reach + 1, F.lit(0)) / BLOCK), F.floor(F.col("idx") / BLOCK))
    parts = rows.select("id", "sent", "idx", "start", "token", lengths.alias("lengths"), F.explode(blocks).alias("block"))
    parts = parts.groupBy("id", "sent", "block").agg(F.array_sort(F.collect_list(F.struct("idx", "start", "token", "lengths"))).alias("t"))
    # what a block's row yields is its spans only: its tokens are not copied for each of them
    begins = F.filter("t", lambda x: (F.size(x["lengths"]) > 0) & (F.floor(x["idx"] / BLOCK) == F.col("block")))
    place = lambda x: x["idx"] - F.get("t", F.lit(0))["idx"]
    fitting = lambda x: F.filter(x["lengths"], lambda n: place(x) + n <= F.size("t"))
    spans = F.transform(begins, lambda x: F.transform(fitting(x), lambda n: F.struct(x["idx"].alias("idx"), n.alias("span"), F.slice("t", place(x) + 1, n).alias("p"))))
    hits = parts.select("id", "sent", F.explode(F.flatten(spans)).alias("x")).select("id", "sent", "x.idx", "x.span", "x.p")
    last = F.element_at("p", -1)
    return hits.select("id", "sent", "idx", "span", F.col("p")[0]["start"].alias("start"), (last["start"] + F.length(last["token"])).alias("end"), _span_text(F.col("p")).alias("raw")).filter(F.length("raw") > 1)


def islands(spans: DataFrame) -> DataFrame:
    """(id, sent, idx, span, ..) with island: spans of different islands of a sentence never overlap.

    An island begins where no earlier span reaches, by a running maximum of the ends, so that a sentence need not be one row.
    """
    order = Window.partitionBy("id", "sent").orderBy("idx", F.desc("span"))
    reached = F.max(F.col("idx") + F.col("span")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.coalesce(F.col("idx") >= reached, F.lit(True)), F.col("idx"))
    return spans.withColumn("_new", new).withColumn("island", F.max("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def leftmost_longest(spans: DataFrame) -> DataFrame:
    """Of (id, sent, idx, span, ..) those that are taken from left to right, longest first, without overlaps; chosen island by island."""
    extra = [c for c in spans.columns if c not in ("id", "sent", "idx", "span")]
    groups = islands(spans).groupBy("id", "sent", "island").agg(F.array_sort(F.collect_list(F.struct("idx", (-F.col("span")).alias("neg"), *extra))).alias("all"))

    @F.pandas_udf("array<int>")
    def taken(idx: pd.Series, neg: pd.Series) -> pd.Series:
        out = []
        for at, minus in zip(idx, neg, strict=True):
            chosen, following = [], 0
            for k, (i, n) in enumerate(zip(at.tolist(), minus.tolist(), strict=True)):
                if i >= following:
                    chosen.append(k)
                    following = i - n
            out.append(chosen)
        return pd.Series(out, dtype=object)

    chosen = groups.select("id", "sent", "all", F.explode(taken("all.idx", "all.neg")).alias("k")).select("id", "sent", F.get("all", F.col("k")).alias("x"))
    return chosen.select("id", "sent", "x.idx", (-F.col("x.neg")).alias("span"), *[f"x.{c}" for c in extra])


#: What is told of an annotation besides its place: its string, parts of its best match, and all matches, best first.
TOLD = ("raw", "db", "term_id", "curie", "entry_name", "score", "others", "url", "matches")


def best_matches(matches: DataFrame, key: Sequence[str] = ("raw",)) -> DataFrame:
    """ground()'s rows -> key, matches: an array of structs, best first."""
    others = F.array_except(F.array_distinct(F.transform(curie.match_groundings(F.col("term"), F.col("subsumed_terms")), lambda g: curie.get_curie(g["db"], g["id"]))), F.array("curie"))
    one = F.struct("rank", "db", F.col("id").alias("term_id"), "curie", F.col("term.entry_name").alias("entry_name"), "score", others.alias("others"), "url")
    return matches.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("matches"))


def _named(columns: Sequence[str]) -> list[Column]:
    top = F.col("matches")[0]
    return [F.col(c) if c in ("raw", "matches") else top[c].alias(c) for c in columns]


def annotated(
    docs: DataFrame, grounder: Grounder, column: str = "text", id_: str = "id", organisms=None, namespaces=None, stop_words: Sequence[str] = ENTITY_STOP_WORDS, split=None, simple: bool = False,
    boundaries: Boundaries = NONE, columns: Sequence[str] = TOLD,
) -> DataFrame:
    """id, annotations: what annotate() finds without models, an array of structs a document, in order of the text.

    columns: those of TOLD that are wanted, at least one. A document without annotations has no row.
    """
    codes = told(grounder.terms)
    if codes is None:
        rows = _by_rows(docs, grounder, column, id_, organisms, namespaces, stop_words, split, simple, None, boundaries)
        one = F.struct("sent", "span", "start", "end", *columns)
        # by place only: matches may hold what has no order
        return rows.groupBy("id").agg(F.array_sort(F.collect_list(one), lambda a, b: a["start"] - b["start"]).alias("annotations"))

    def answer(strings: DataFrame) -> DataFrame:
        matches = grounder.ground(strings, organisms=organisms, namespaces=namespaces)
        # where only parts of the best match are wanted, the others go before they are put together
        best = best_matches(matches if "matches" in columns else matches.filter("rank = 1"))
        return best.select("raw", F.struct(*_named(columns)).alias("answer"))

    return found_spans(docs, column, id_, codes, answer, *cutters(split, simple, boundaries), stop_words, CORE_STOP_WORDS, grounder.variants)


def annotate(
    docs: DataFrame, grounder: Grounder, column: str = "text", id_: str = "id", organisms=None, namespaces=None, stop_words: Sequence[str] = ENTITY_STOP_WORDS, split=None, simple: bool = False,
    context: str | None = None, boundaries: Boundaries = NONE, columns: Sequence[str] = TOLD,
) -> DataFrame:
    """id, sent, start, end, raw, the best match's db, term_id, curie, entry_name, score, others, url, and all matches, best first.

    Offsets are characters of the text. Where the grounder has models, each span is grounded in its document's context:
    the column `context`, or else the text itself. columns: those of TOLD that are wanted.
    """
    if grounder.models is not None:
        return _by_rows(docs, grounder, column, id_, organisms, namespaces, stop_words, split, simple, context, boundaries).select("id", "sent", "span", "start", "end", *columns)
    found = annotated(docs, grounder, column, id_, organisms, namespaces, stop_words, split, simple, boundaries, columns)
    return found.select("id", F.inline("annotations"))


def counted(docs: DataFrame, grounder: Grounder, column: str, id_: str, **options) -> DataFrame:
    """The id under its own name and n_annotations of documents with any; options as for annotated()."""
    found = annotated(docs, grounder, column, id_, columns=("score",), **options)
    return found.groupBy(F.col("id").alias(id_)).agg(F.sum(F.size("annotations")).alias("n_annotations"))


def _by_rows(docs: DataFrame, grounder: Grounder, column: str, id_: str, organisms, namespaces, stop_words: Sequence[str], split, simple: bool, context: str | None, boundaries: Boundaries) -> DataFrame:
    # read twice: by the distinct strings to be grounded, and by what is joined back
    spans = reused(candidates(tokens(docs, column, id_, split, simple, boundaries), prefix_index(grounder.terms), stop_words))
    found = spans.select("id", "raw").distinct()
    key = ["raw"]
    if grounder.models is not None:
        texts = docs.select(F.col(id_).alias("id"), F.col(context or column).alias("context"))
        key = ["raw", "context_key"]
        ids = texts.select("id", context_key("context").alias("context_key"))
        asked = found.join(ids, "id")
        matches = grounder.ground_in(asked.select(*key), texts.select(context_key("context").alias("context_key"), "context"), organisms=organisms, namespaces=namespaces)
        spans = spans.join(ids, "id")
    else:
        matches = grounder.ground(found, organisms=organisms, namespaces=namespaces)
    # ground() strips its strings, and spans have no outer white space. The choice needs no more than that a string has a match.
    best = reused(best_matches(matches, key))
    chosen = leftmost_longest(spans.join(best.select(*key), key, "left_semi"))
    rows = chosen.join(best, key, "left").drop("idx", "context_key")
    return rows.select("id", "sent", "span", "start", "end", *_named(TOLD))


def standoff(annotations: str, entity_type: str = "Entity", offset: int = 1, include_text: bool = True) -> Column:
    """Two lines an annotation of an array of structs with start, end, raw and curie."""
    first = max(1, offset)
    system = f"; Reading system: {entity_type}" if entity_type != "Entity" else ""
    line = lambda a, k: F.concat(
        F.lit("T"), (k + first).cast("string"), F.lit(f"\t{entity_type} "), a["start"].cast("string"), F.lit(" "), a["end"].cast("string"), *([F.lit("\t"), a["raw"]] if include_text else []),
        F.lit("\n#"), (k + first).cast("string"), F.lit("\tAnnotatorNotes T"), (k + first).cast("string"), F.lit("\t"), F.coalesce(a["curie"], F.lit("None")), F.lit(system),
    )
    return F.concat(F.array_join(F.transform(annotations, line), "\n"), F.lit("\n"))


def brat(annotations: DataFrame, entity_type: str = "Entity", offset: int = 1, include_text: bool = True) -> DataFrame:
    """id, brat: two lines an annotation, in order of start."""
    groups = annotations.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "raw", "curie"))).alias("a"))
    return groups.select("id", standoff("a", entity_type, offset, include_text).alias("brat"))


def annotation_rows(annotations: DataFrame) -> DataFrame:
    """A flat file's rows: id, start, end, text, grounding, standard_name, score with four decimals, additional_groundings, url."""
    return annotations.select(
        "id", "start", "end", F.col("raw").alias("text"), F.col("curie").alias("grounding"), F.col("entry_name").alias("standard_name"),
        F.format_string("%.4f", "score").alias("score"), F.array_join("others", ", ").alias("additional_groundings"), "url",
    )


def annotation_json(annotations: DataFrame) -> DataFrame:
    """id, start, json: text, offsets and all matches of each annotation."""
    return annotations.select("id", "start", F.to_json(F.struct(F.col("raw").alias("text"), "start", "end", "matches")).alias("json"))


def escape_html(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def annotated_html(docs: DataFrame, annotations: DataFrame, column: str = "text", id_: str = "id") -> DataFrame:
    """id, html: the text with a span around each annotation, its CURIE as the title."""
    groups = annotations.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "curie"))).alias("a"))
    rows = docs.select(F.col(id_).alias("id"), F.col(column).alias("t")).join(groups, "id", "left")
    piece = lambda a, z: escape_html(F.substr("t", a + 1, z - a))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("html"))
    mark = lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["html"], piece(s["at"], x["start"]), F.lit('<span class="match" title="'), F.coalesce(escape_html(x["curie"]), F.lit("")), F.lit('">'), piece(x["start"], x["end"]), F.lit("</span>")).alias("html"))
    done = F.aggregate(F.coalesce("a", F.array().cast("array<struct<start:int,end:int,curie:string>>")), start, mark)
    return rows.select("id", F.concat(done["html"], piece(done["at"], F.length("t"))).alias("html"))
