"""The pipeline on a small table: each stage's decisions take effect and clean documents stay."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(n))
    item, shared = text(30), text(25)
    rows = [(i, text(80), "en", rng.choice("abc")) for i in range(40)]
    rows += [(100, rows[0][1], "en", "a"), (101, text(30) + " " + item + " " + text(9), "en", "a"), (102, text(40) + " " + shared, "en", "b"), (103, text(40) + " " + shared, "en", "b"), (104, "12 34", "en", "c"), (105, None, "en", "c")]
    docs = spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.collect(), docs.schema)
        kept.append({r.doc_id: r.text for r in now.collect()})
    everything = {r[0] for r in rows}
    assert set(kept[0]) == everything - {104, 105}
    assert set(kept[1]) == everything - {104, 105, 100}
    assert set(kept[2]) == set(kept[1]) and shared in kept[2][102] and shared not in kept[2][103]
    assert set(kept[3]) == set(kept[2]) - {101}
    mix = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert mix and all(r.taken <= 3 * r.size for r in mix) and {r.doc_id for r in mix} <= set(kept[3])


NAMES = ("doc", "runs", "later", "bad", "row", "print", "firsts", "gain", "n", "fa", "rep", "token", "range")


def test_stages_keep_columns_that_clash(spark, tmp_path):
    """Nulls, repeats, a shared doc_id, a very long text and extra columns with the operators' own names."""
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(n))
    rows = [(i, text(60), "en", "a", 0) for i in range(30)] + [(7, text(60), "en", "a", 0), (3, None, None, None, 0), (50, text(12000), "en", "b", 0), (None, text(40), "en", "b", 0)]
    rows += [(60, rows[0][1], "en", "a", 0), (60, rows[0][1], "en", "a", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in NAMES)
    docs = spark.createDataFrame([(*r, *range(len(NAMES))) for r in rows], schema)
    spark.createDataFrame([(1, "an item of words that is in none of them")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.collect(), docs.schema)
        kept = now.collect()
        assert all(tuple(r)[5:] == tuple(range(len(NAMES))) for r in kept), name
    ids = [r.doc_id for r in kept]
    assert 60 not in ids and {*range(30), 50, None} - {3} <= set(ids)
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() > 0


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def plain_pipeline(rows, items):
    """All five stages by plain loops; rows are (doc_id, text, lang, source, n_chars). The result: {doc_id: (size, taken)}."""
    import re

    import duckdb
    import pandas as pd

    from vocabrook.llm import decontaminate, source_mix

    docs = [(d, t, s) for d, t, _, s, _ in rows if t and re.search(r"[a-z]", t)]  # every text with letters is of a learnt language here
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    root = {d: d for d, _, _ in docs}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i in range(len(docs)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(docs[i][0]), top(docs[j][0])))
                root[b] = a
    docs = sorted((d, t, s) for d, t, s in docs if top(d) == d)
    seen, cut = set(), []
    for d, t, s in docs:
        b = t.encode()
        grams = [b[i : i + 50] for i in range(len(b) - 49)]
        gone = {k for i, g in enumerate(grams) if g in seen for k in range(i, i + 50)}
        cut.append((d, bytes(x for k, x in enumerate(b) if k not in gone).decode("utf-8", "ignore"), s))
        seen.update(grams)

    def edits(x, text):
        row = list(range(len(text) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, u in enumerate(text, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != u))
        return min(row)

    clean = []
    for d, t, s in cut:
        n, bad = decontaminate.normal(t), False
        for _, item in items:
            x = decontaminate.normal(item)
            limit = decontaminate.allowed(len(x))
            for start in (m.start() for m in re.finditer(rb"(?:^|(?<= ))[^ ]", n)):
                # a window with half of the item's words in it
                near = n[start : start + len(x) + limit]
                bad = bad or len(set(near.split()) & set(x.split())) * 2 > len(set(x.split())) and edits(x, near) <= limit
        if not bad:
            clean.append((d, t, s))
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(clean, columns=["doc_id", "text", "source"]))
    con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM frame")
    return {r[0]: (r[1], r[4]) for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({source_mix.ORACLE})").fetchall() if r[4]}


def test_run_against_plain_loops(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(28)) for k in range(3)]
    passages = [text(22) for _ in range(3)]
    rows = [(i, text(rng.randint(40, 90)), "en") for i in range(60)]
    for k in range(12):  # chains of near copies, each a word from the one before
        words = rows[k % 4][1].split() if k < 4 else rows[-1][1].split()
        words[rng.randrange(len(words))] = word()
        rows.append((100 + k, " ".join(words), "en"))
    rows += [(200 + k, f"{text(30)} {passages[k % 3]} {text(12)}", "en") for k in range(9)]
    for k in range(6):  # items, half of them with an edit
        item = items[k % 3][1] if k % 2 else items[k % 3][1][:40] + "qq" + items[k % 3][1][41:]
        rows.append((300 + k, f"{text(25)} {item} {text(10)}", "en"))
    rows += [(400, "12 34 !", "en"), (401, None, "en"), (402, "", None), (403, rows[5][1].upper().lower(), None)]
    rows = [(d, t, lang, rng.choice(["a", "b", "b", "c", None]), len(t or "")) for d, t, lang in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r["size"], r.taken) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == plain_pipeline(rows, items)
    # what was planted is gone: copies, the first document with each item (later ones lost it as a repeated passage)
    assert not {403, 400, 401, 402, 300, 301, 302} & set(got) and 200 in got
