"""Context disambiguation: matches re-weighted by the label probabilities of a surface's model.

A model is rows (surface, kind, label, feature, weight, idf) plus a row with a null feature for each label's intercept: a
linear classifier over words and pairs of successive words, scored as joins, sums and a softmax. A feature with an idf
counts as its number in the context times idf, and a context's vector of such features is divided by its length, so
each label has a row for every feature of its model, also of weight 0. A feature without (idf null, or no such column)
counts as 1 if it is there at all.

kind 'adeft' multiplies matches without a label by the probability of 'ungrounded' (1 if there is none), kind 'own' by 0.
Of two kinds for one surface, adeft is used. learning.learn() and sources.lexicon.read_model_rows() give such rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word of a lower-case context.
WORD = r"[\p{L}\p{N}_]+"


#: Words of all models are broadcast up to so many, after counting them.
FEATURES = 200_000


def grams(column, pattern: str = WORD, pairs: Column | bool = True) -> Column:
    """Array of a text's words and, if wanted, its pairs of successive words, as often as they are there."""
    words = F.regexp_extract_all(F.lower(column), F.lit(pattern), F.lit(0))
    two = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    both = F.concat(words, F.when(F.size(words) > 1, two).otherwise(F.array().cast("array<string>")))
    return F.when(F.lit(pairs) if isinstance(pairs, bool) else pairs, both).otherwise(words)


def label_probabilities(asked: DataFrame, contexts: DataFrame, models: DataFrame, pattern: str = WORD) -> DataFrame:
    """asked(raw, context_key), contexts(context_key, context), models -> raw, context_key, kind, label, probability, for strings
    that have a model. pattern: a word of a lower-case context.

    Texts are cut to counted words and pairs and take part in no join: such a word is a row of its key, itself and its
    number. Pairs are made only if a model has any. Words and the models' rows are broadcast if they are FEATURES at most: the
    words to drop what no model knows, the rows so that a context's words stay where they are.
    """
    models = models if "idf" in models.columns else models.withColumn("idf", F.lit(None).cast("double"))
    kinds = models.groupBy("surface").agg(F.min("kind").alias("kind"))
    models = models.join(kinds, ["surface", "kind"]).withColumnRenamed("surface", "raw")
    base = models.filter("feature is null").select("raw", "kind", "label", F.col("weight").alias("intercept"))
    asked = asked.filter("context_key is not null").select("raw", "context_key").distinct()
    asked = asked.join(kinds.select(F.col("surface").alias("raw")), "raw", "left_semi")
    filled = contexts.filter("context is not null and context <> ''")
    seen = filled.groupBy("context_key").agg(F.count("*").alias("copies"))
    asked = asked.hint("merge").join(seen, "context_key")
    features = models.filter("feature is not null").select("raw", "label", "feature", "weight", "idf")
    paired = features.agg((F.count_if(F.contains("feature", F.lit(" "))) > 0).alias("any")).scalar()
    words = filled.select("context_key", F.explode(grams("context", pattern, paired)).alias("feature"))
    known = features.select("feature").distinct()
    if known.limit(FEATURES + 1).count() <= FEATURES:
        # of most words no model knows anything: they go before they are counted
        words = words.join(F.broadcast(known), "feature", "left_semi")
    words = words.groupBy("context_key", "feature").agg(F.count("*").alias("times"))
    few = features.limit(FEATURES + 1).count() <= FEATURES
    return _softmax(asked, words, F.broadcast(features) if few else features.hint("merge"), base)


def _softmax(asked: DataFrame, words: DataFrame, features: DataFrame, base: DataFrame) -> DataFrame:
    # a context that is given several times was counted as often
    part = F.col("times") / F.col("copies") * F.col("idf")
    sums = F.sum(F.col("weight") * F.coalesce(part, F.lit(1.0))).alias("w"), F.sum(part * part).alias("q")
    hits = asked.hint("merge").join(words, "context_key").join(features, ["raw", "feature"]).groupBy("raw", "context_key", "label").agg(*sums)
    inner = F.coalesce(F.when(F.col("q") > 0, F.col("w") / F.sqrt("q")).otherwise(F.col("w")), F.lit(0.0))
    logits = asked.hint("merge").join(base, "raw").hint("merge").join(hits, ["raw", "context_key", "label"], "left").withColumn("z", F.col("intercept") + inner)
    group = Window.partitionBy("raw", "context_key")
    e = F.exp(F.col("z") - F.max("z").over(group))
    return logits.withColumn("e", e).select("raw", "context_key", "kind", "label", (F.col("e") / F.sum("e").over(group)).alias("probability"))


def disambiguate(matches: DataFrame, contexts: DataFrame, models: DataFrame | None) -> DataFrame:
    """matches(raw, context_key, db, id, score, ..) with scores multiplied and a disambiguation struct (null without a model)."""
    kind = "struct<type:string,score:double,match:string>"
    if models is None:
        return matches.withColumn("disambiguation", F.lit(None).cast(kind))
    known = label_probabilities(matches, contexts, models)
    key = ["raw", "context_key"]
    labels = known.filter(F.contains("label", F.lit(":"))).select(*key, F.split("label", ":", 2)[0].alias("db"), F.split("label", ":", 2)[1].alias("id"), "probability")
    rest = known.groupBy(*key).agg(F.first("kind").alias("kind"), F.max(F.when(F.col("label") == "ungrounded", F.col("probability"))).alias("none"))
    rows = matches.hint("merge").join(rest, key, "left").hint("merge").join(labels, [*key, "db", "id"], "left")
    other = F.when(F.col("kind") == "adeft", F.coalesce("none", F.lit(1.0))).otherwise(F.lit(0.0))
    factor = F.coalesce("probability", other)
    info = F.struct(F.when(F.col("kind") == "adeft", "adeft").otherwise("own").alias("type"), factor.alias("score"), F.when(F.col("probability").isNotNull(), "grounded").otherwise("ungrounded").alias("match"))
    rows = rows.withColumn("disambiguation", F.when(F.col("kind").isNotNull(), info).cast(kind))
    rows = rows.withColumn("score", F.when(F.col("kind").isNotNull(), F.col("score") * factor).otherwise(F.col("score")))
    return rows.drop("kind", "none", "probability")


def trainable(texts: DataFrame, label: str = "label", least: int = 5) -> DataFrame:
    """surface of those with at least two labels, each of more than `least` texts."""
    return texts.groupBy("surface", label).count().groupBy("surface").agg(F.count("*").alias("n"), F.min("count").alias("m")).filter((F.col("n") >= 2) & (F.col("m") > least)).select("surface")


def unique_pmids(papers: DataFrame, most: int = 1000) -> DataFrame:
    """(pmid, label): papers seen for one label only, at most `most` a label by falling pmid."""
    once = papers.distinct().withColumn("_n", F.count("*").over(Window.partitionBy("pmid"))).filter("_n = 1").drop("_n")
    return once.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("pmid")))).filter(F.col("_r") <= most).drop("_r")


def enough_texts(texts: DataFrame, least: int = 6) -> DataFrame:
    """surface, label, text: where a label has fewer than `least` texts, its longest is cut in half until it has as many."""

    @F.pandas_udf("array<string>")
    def halved(groups: pd.Series) -> pd.Series:
        def cut(ts):
            ts = sorted(ts, key=len, reverse=True)
            while len(ts) < least and len(ts[0]) > 1:
                half = len(ts[0]) // 2
                ts = sorted([ts[0][:half], ts[0][half:], *ts[1:]], key=len, reverse=True)
            return ts

        return pd.Series([cut(list(g)) for g in groups], dtype=object)

    n = texts.groupBy("surface", "label").agg(F.count("*").alias("n"))
    few = texts.join(n.filter(F.col("n") < least).select("surface", "label"), ["surface", "label"], "left_semi").groupBy("surface", "label").agg(F.collect_list("text").alias("ts"))
    few = few.select("surface", "label", F.explode(halved("ts")).alias("text"))
    return texts.join(n.filter(F.col("n") >= least).select("surface", "label"), ["surface", "label"], "left_semi").select("surface", "label", "text").unionByName(few)


def training_texts(papers: DataFrame, texts: DataFrame, most: int = 1000, least: int = 6) -> DataFrame:
    """papers(surface, pmid, label), texts(pmid, text) -> surface, label, text of the surfaces that can be trained.

    A paper counts if it is of one label of its surface only; at most `most` a label, by falling pmid.
    """
    once = papers.groupBy("surface", "pmid").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    turn = F.row_number().over(Window.partitionBy("surface", "label").orderBy(F.desc("pmid")))
    chosen = once.withColumn("turn", turn).filter(F.col("turn") <= most).drop("turn")
    rows = enough_texts(chosen.join(texts.filter("text <> ''"), "pmid").select("surface", "label", "text"), least)
    return rows.join(trainable(rows, least=least - 1), "surface", "left_semi")


def train(texts: DataFrame, sizes: Sequence[int] = (100, 1000), folds: int = 5, strength: float = 10.0):
    """A TF-IDF n-gram (1, 2) logistic regression of one surface's (text, label) rows, with cross-validation: (model, mean F1).

    Smaller weights cost 1 / strength a text. model_rows() makes a model's rows of it; learning.learn() fits all surfaces at once.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    counts = CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=max(sizes))
    steps = [
        StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"), RegexTokenizer(inputCol="text", outputCol="w1", pattern=WORD, gaps=False), NGram(n=2, inputCol="w1", outputCol="w2"),
        SQLTransformer(statement="select *, concat(w1, w2) as grams from __THIS__"), counts, IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / (strength * texts.count()), standardization=False, maxIter=300, tol=1e-9),
    ]
    grid = ParamGridBuilder().addGrid(counts.vocabSize, list(sizes)).build()
    search = CrossValidator(estimator=Pipeline(stages=steps), estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="f1"), numFolds=folds, seed=1)
    model = search.fit(texts)
    return model.bestModel, max(model.avgMetrics)


def model_rows(spark, model, surface: str, kind: str = "own") -> DataFrame:
    """The rows of a model that train() gave; its size is that of the vocabulary times the labels."""
    labels, words, idf, fit = model.stages[0].labels, model.stages[4].vocabulary, model.stages[5].idf.toArray(), model.stages[-1]
    weights, intercepts = fit.coefficientMatrix.toArray(), fit.interceptVector.toArray()
    if len(labels) == 2:  # one vector tells the second label from the first
        weights, intercepts = [weights[0] * 0, weights[0]], [0.0, intercepts[0]]
    rows = [(surface, kind, label, None, float(b), None) for label, b in zip(labels, intercepts, strict=True)]
    rows += [(surface, kind, label, word, float(w), float(i)) for label, ws in zip(labels, weights, strict=True) for word, w, i in zip(words, ws, idf, strict=True)]
    return spark.createDataFrame(rows, "surface string, kind string, label string, feature string, weight double, idf double")
