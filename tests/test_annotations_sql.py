"""Annotation queries against their SQL and against a plainer path."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from vocabrook.functions import forms, text
from vocabrook.operators import annotation, found_spans, sentences
from vocabrook.operators.grounding import Grounder
from vocabrook.plans import oracles, queries

N = None


def by_sql(name, tables):
    con = duckdb.connect()
    for t, path in tables.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return sorted(con.execute(oracles.sql()[name]).fetchall())


def test_annotations_has_entries_own_words_as_its_sql(spark, tmp_path):
    """A plural that only a spelling variant finds counts in annotations_all, not in annotations."""
    texts = {1: "lumen zentra " * 40, 2: "lumen zentras and Lumen, Zentra", 3: "zentra lumen\nlumen", 4: "the lumen zentrases II", 5: "zentras\n" * 40}
    rows = [(k, t, "en") for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in queries.annotations(spark, str(tmp_path)).collect())
    assert got == by_sql("annotations", {"documents": tmp_path / "documents.parquet"}) == [(1, 40), (2, 3), (3, 2), (4, 1), (5, 40)]
    # with variants, 'lumen zentras' is one span, a plural of 'lumen zentra'
    found = {r.doc_id: r.n_annotations for r in queries.annotations_all(spark, str(tmp_path)).collect()}
    assert found == {1: 40, 2: 2, 3: 2, 4: 1, 5: 40}


def test_forms_in_python_are_those_of_the_columns(spark):
    """All characters that have a script inside a word, and strings that have spelling variants."""
    words = ["il-2", "Alpha", "betas", "xx", "IV", "viii", "10", "mosquitoes", "antibodies", "boxes", "crisis", "CDs", "β", "Straße", "s", "ies", "a−b", "nu", "pinu", "Ωmega", "éque", "ΣΑΣ", "don", "'t", "É", "lamda", "\U0001d6fc", "\U00010400β"]
    rnd = random.Random(3)
    raws = words + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(1500)] + ["a  b", "x-II", "x 1x", "x-3", "x 2"]
    every = [f"a{chr(c)}B" for c in range(1, 0x20000) if not 0xD800 <= c < 0xF900]
    got = spark.createDataFrame([(r,) for r in every], "raw string").select("raw", text.normalize("raw").alias("n")).collect()
    assert [r.raw for r in got if forms.normalized(r.raw) != r.n] == []
    both = spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", text.normalize("raw").alias("n"), text.lookups("raw").alias("l")).collect()
    for r in both:
        assert forms.normalized(r.raw) == r.n and forms.lookups(r.raw) == set(r.l), r.raw
        tokens = r.raw.split(" ")
        if not any(map(forms.is_odd, tokens)) and not forms.is_odd_last(tokens[-1]):
            assert r.l == [r.raw.lower()], r.raw


@pytest.mark.parametrize("strings, chars", [(200_000, 1_000_000), (3, 40)])
def test_packed_spans_give_the_rows_of_the_joins(spark, monkeypatch, strings, chars):
    """A document's spans as one row and blocks of few strings against tokens and spans as rows."""
    rnd = random.Random(8)
    words = ["alpha", "beta", "IL-2", "il", "2", "cell", "cells", "Death", "zeta", "IV", "β", "Größe", "s", "the", "can", "cannot", "E.", "coli", "A", "x", "\U0001d6fc"]
    texts = {" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(80)} | {"A", "\U0001d6fc", "beta 4"}
    spark_rows = [(t, rnd.choice(["X", "Y"]), str(k % 30), "name" if k % 2 else "synonym", N if k % 3 else "9606") for k, t in enumerate(sorted(texts))]
    terms = spark.createDataFrame(spark_rows, "text string, db string, id string, status string, organism string")
    null = F.lit(N).cast("string")
    terms = terms.select(text.normalize("text").alias("norm_text"), "text", "db", "id", F.col("text").alias("entry_name"), "status", F.lit("s").alias("source"), "organism", null.alias("source_db"), null.alias("source_id"))
    signs = [" ", " ", " ", "  ", ", ", ". ", "-", "\n", "", " ("]
    docs = [(k, "".join(rnd.choice(words) + rnd.choice(signs) for _ in range(rnd.randint(0, 90)))) for k in range(60)] + [(60, ""), (61, N), (N, "alpha beta"), (62, "beta cells " * 300)]
    docs = spark.createDataFrame(docs, "id long, text string").repartition(3, "id")
    monkeypatch.setattr(found_spans, "STRINGS", strings)
    monkeypatch.setattr(found_spans, "CHARS", chars)
    monkeypatch.setattr(found_spans, "ROWS", 5 if strings == 3 else 50_000)
    shape = lambda df: sorted((r.asDict(True) for r in df.collect()), key=lambda r: (r["id"] is None, r["id"] or 0, r["start"]))
    for variants, simple, namespaces in ((True, False, N), (False, False, N), (True, True, ["Y"])):
        g = Grounder(spark, terms, variants=variants)
        options = {"simple": simple, "namespaces": namespaces}
        packed = shape(annotation.annotate(docs, g, **options))
        with monkeypatch.context() as m:
            m.setattr(found_spans, "MOST", 3)
            rows = shape(annotation.annotate(docs, g, **options))
            by_document = annotation.annotated(docs, g, columns=("raw", "curie"), **options).collect()
        assert packed == rows and len(rows) > 100
        told = {r.id: r.annotations for r in annotation.annotated(docs, g, columns=("raw", "curie"), **options).collect()}
        assert told == {r.id: r.annotations for r in by_document}
        lines = {r.id: r.brat for r in annotation.brat(annotation.annotate(docs, g, **options)).collect()}
        assert lines == {r.id: r.brat for r in annotation.annotated(docs, g, columns=("raw", "curie"), **options).select("id", annotation.standoff("annotations").alias("brat")).collect()}


def test_neither_tokens_nor_texts_are_shuffled(spark):
    """What is exchanged for a document is its packed spans: the text, and its tokens as rows, go through no exchange."""
    docs = spark.createDataFrame([(k, "alpha beta xx " * 400) for k in range(20)], "id long, text string")
    null = F.lit(N).cast("string")
    terms = spark.createDataFrame([("alpha",), ("alpha beta",)], "text string").select(F.col("text").alias("norm_text"), "text", F.lit("X").alias("db"), F.col("text").alias("id"), F.col("text").alias("entry_name"), F.lit("name").alias("status"), F.lit("s").alias("source"), null.alias("organism"), null.alias("source_db"), null.alias("source_id"))
    codes = found_spans.told(terms)
    spans = found_spans.packed(docs, "text", "id", codes, *annotation.cutters(), frozenset(), frozenset(), True)
    assert "Exchange" not in spans._jdf.queryExecution().executedPlan().toString()
    rows = spans.collect()
    assert [r.raws for r in rows if r.raws] and all(set(r.raws) <= {"alpha", "alpha beta"} for r in rows if r.raws)
    assert sorted(r.id for r in rows if r.spans) == list(range(20)) and all(r.n == 800 for r in rows if r.spans)
    assert sum(len(r.spans) for r in rows if r.spans) < 20 * 1_400


def test_words_are_counted_where_texts_are_read(spark, monkeypatch):
    """Counts of words and of pairs behind a full stop against the rows of words()."""
    monkeypatch.setattr(sentences, "HELD", 50)
    rnd = random.Random(2)
    tokens = ["Dr.", "e.g.", "Zeit.", "lumen", "(Lumen)", "3,5.", "-12", "1.2.", "...", "a..", "x. ", " y", "5\x85", "\"'", "(\"quoted.\"", "¼", "٣.", "—", "É.", "#", "#.", "end.)", "o\x1cp."]
    texts = [rnd.choice([" ", "\n", "\t"]).join(rnd.choice(tokens) for _ in range(rnd.randint(0, 60))) for _ in range(80)] + [N, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = sentences.words(docs).cache()
    by_word = rows.groupBy("word").agg(F.count_if("stop").alias("a"), F.count_if(~F.col("stop")).alias("b"))
    pairs = rows.filter("stop and next is not null").groupBy("word", "next").count()
    want = {(r.word, N): (r.a, r.b) for r in by_word.collect()} | {(r.word, r.next): (r["count"], 0) for r in pairs.collect()}
    counts = sentences.word_counts(docs)
    assert {(r.word, r.next): (r.with_stop, r.without) for r in counts.collect()} == want and len(want) > 100


def test_frequent_grams_are_counted_once(spark):
    """Models read the kept counts, not the texts; a context's words stay where they are for models of few rows, not of many."""
    from vocabrook.operators import disambiguation
    from vocabrook.plans import benchmark_queries

    docs = spark.createDataFrame([(k, f"the er lumen {'zentra ' * (k % 3)} x{k}", str(k)) for k in range(30)], "doc_id int, text string, context_key string")
    models = benchmark_queries.gram_models(docs)
    assert "regexp_extract_all" not in models._jdf.queryExecution().optimizedPlan().toString() and models.count() > 10
    ask = lambda: disambiguation.label_probabilities(docs.select(F.lit("er").alias("raw"), "context_key"), docs.select("context_key", F.col("text").alias("context")), models, "[a-z0-9]+")
    told = {(r.context_key, r.label): round(r.probability, 12) for r in ask().collect()}
    plan = ask()._jdf.queryExecution().optimizedPlan().toString()
    before, disambiguation.FEATURES = disambiguation.FEATURES, 1
    try:
        assert {(r.context_key, r.label): round(r.probability, 12) for r in ask().collect()} == told and len(told) == 60
        assert plan.count("strategy=broadcast") > ask()._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") + 1
    finally:
        disambiguation.FEATURES = before
