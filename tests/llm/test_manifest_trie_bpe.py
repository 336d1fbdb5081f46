"""Merkle manifest, conversation trie and BPE, each against a brute-force version and, where there is one, its SQL."""

import hashlib
import random
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from vocabrook.llm import bpe_trie, common, conversation_trie, merkle_manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def by_duckdb(sql: str, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"{name}_rows", df.toArrow())
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM {name}_rows")
    cur = con.execute(sql)
    return {c[0] for c in cur.description}, [dict(zip([c[0] for c in cur.description], r, strict=True)) for r in cur.fetchall()]


def same_rows(df, sql, **tables):
    names, rows = by_duckdb(sql, **tables)
    assert names == set(df.columns)
    order = sorted(names)
    mine = sorted(repr([r[c] for c in order]) for r in df.collect())
    assert mine == sorted(repr([r[c] for c in order]) for r in rows)
    return mine


# ---- Merkle manifest


def merkle(rows):
    """The contract in plain Python: rows are dicts of the five fields."""
    h = lambda xs: sha("".join(xs))
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda r, text: h([field(r["doc_id"]), field(r["source"]), field(r["lang"]), field(r["n_chars"]), field(text)])

    def climb(nodes):
        """(top, for each node its runs on the way up as (digests, slot))."""
        paths, place, at = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
        while len(at) > 1:
            runs = [at[i : i + 8] for i in range(0, len(at), 8)]
            for k, p in enumerate(place):
                paths[k].append((runs[p // 8], p % 8))
                place[k] = p // 8
            at = [h(r) for r in runs]
        return at[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        members = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[g] = (members, *climb([leaf(r, r["text"]) for r in members]))
    root, tops = climb([trees[g][1] for g in order]) if order else (None, [])
    out = []
    for g, top in zip(order, tops, strict=True):
        members, subroot, paths = trees[g]
        for r, path in zip(members, paths, strict=True):
            path = path + top
            text = r["text"]
            if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = text.translate(lower)
            at = leaf(r, text)
            for run, slot in path:
                at = h(run[:slot] + [at] + run[slot + 1 :])
            proof = h([d for run, slot in path for k, d in enumerate(run) if k != slot])
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, proof, at, at == root))
    return sorted(map(repr, out))


def merkle_docs(n, langs, seed=3):
    rnd = random.Random(seed)
    rows = [(k, rnd.choice(["Some Text", "plain", "", None, "Ünï Á"]) if k % 7 else f"Doc {k}", rnd.choice(langs), rnd.choice(["a", None]), rnd.choice([k, None])) for k in range(n)]
    return rows


@pytest.mark.parametrize(
    "rows",
    [
        merkle_docs(700, ["en"] * 6 + ["fr", None, ""]), merkle_docs(64, ["en"]), merkle_docs(65, ["en"]), [(1, "A", "x", "s", 1)], [(1, "A", "x", "s", 1), (2, "B", "é", "s", 1), (3, "C", None, "s", 1)],
        merkle_docs(30, [f"l{k}" for k in range(12)]), [(5, "Same", "en", None, 1)] * 9 + [(None, "Lost", "en", None, 1), (5, "Other", "en", None, None)], [(3, "Ab" * 200_000, None, None, None)],
    ],
)
def test_merkle_against_brute_force_and_sql(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    found = merkle_manifest.digest(docs.withColumns({c: F.lit("x") for c in ("group", "leaf", "idx", "n", "hash", "path", "slot", "root")}))
    mine = sorted(repr(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))) for r in found.collect())
    assert mine == merkle([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows])
    if all(r[0] is not None for r in rows):
        same_rows(found, merkle_manifest.ORACLE, documents=docs)


def test_merkle_empty_table(spark):
    assert merkle_manifest.digest(spark.createDataFrame([], DOCS)).collect() == []


def test_merkle_levels_two_at_a_time(spark):
    folder = Path(common.shared_dir(spark).split("://")[-1])
    here = set(folder.iterdir())
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 1) for i in range(600)], DOCS)  # levels of 600, 75, 10, 2, 1 nodes
    found = merkle_manifest.digest(docs)
    made = sorted(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - here)
    assert [n for n in made if n.startswith("merkle-level")] == ["merkle-level1", "merkle-level2"]
    assert not {"merkle-rows", "merkle-leaves", "merkle-leaves-parts", "merkle-nodes"} & set(made), "rows of a leaf each have no files"
    assert found.filter("verified").count() == found.count() == 600 and found.select("root").distinct().count() == 1


# ---- conversation trie


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
    nodes = {p[:d] for p in paths.values() for d in range(len(p) + 1)}
    members = {n: sorted(c for c, p in paths.items() if p[: len(n)] == n) for n in nodes}
    kids = {n: [m for m in nodes if len(m) == len(n) + 1 and m[: len(n)] == n] for n in nodes}
    out = []
    for n in nodes:
        below = [m for m in nodes if m[: len(n)] == n]
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        ends = ",".join(str(c) for c in members[n] if paths[c] == n)
        out.append((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(kids[n]), sum(not kids[m] for m in below), saved, sha(ends)))
    return sorted(map(repr, out))


TURNS = "conv_id long, turn long, role string, text string"


def conversations(seed, n, least=0):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(least, 400), n):
        for t in range(rnd.randint(1, 9)):
            rows.append((c, rnd.choice([t, t, t, None]), rnd.choice(["user", "bot", None]), rnd.choice(["hi", "hi", "yes é", "", None])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "rows",
    [
        conversations(1, 40), conversations(2, 60, 100), [(7, 1, "user", "alone")], [(k, t, "user", f"t{t}") for k in range(100, 160) for t in range(7)] + [(900, None, None, None), (900, None, None, None), (None, 1, "user", "lost")],
        [(200, t, "user", "x") for t in range(30)] + [(201, 0, "user", "y" * 100_000)],
    ],
)
def test_trie_against_brute_force_and_sql(spark, monkeypatch, rows):
    # small blocks and chunks, so that running sums and digests go over their borders
    monkeypatch.setattr(conversation_trie, "BLOCK", 3)
    monkeypatch.setattr(conversation_trie, "CHUNK", 16)
    table = spark.createDataFrame(rows, TURNS)
    found = conversation_trie.trie(table.withColumns({c: F.lit("x") for c in ("place", "n", "a", "len", "depth", "end", "ids")}))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(repr(tuple(r[c] for c in columns)) for r in found.collect()) == plain_trie(rows)
    same_rows(found, conversation_trie.ORACLE, conversations=table)


def test_trie_empty_table(spark):
    assert conversation_trie.trie(spark.createDataFrame([], TURNS)).collect() == []


def test_no_window_over_a_shared_node(spark):
    """Windows go over a conversation's blocks only: the root's members are never gathered in one task."""
    plan = conversation_trie.trie(spark.createDataFrame(conversations(5, 20), TURNS))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


# ---- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_trie.default_vocabulary())


@pytest.fixture(scope="module")
def vocabulary():
    return bpe_trie.Vocabulary(bpe_trie.default_vocabulary())


def mine(vocabulary, text):
    raw = vocabulary.encoded(text)
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


def test_bpe_random_strings(library, vocabulary):
    rnd = random.Random(4)
    pools = ("ab", "aeinrst ", "ABCabc 019'.-\n\t", "éèüßñ漢字かな안녕 😀🎉​  ", "".join(map(chr, range(128))))
    words = [w.decode("utf-8", "replace") for w in rnd.sample(sorted(vocabulary.id), 3000)]
    for k in range(6000):
        text = "".join(rnd.choice(pools[k % len(pools)]) for _ in range(rnd.randint(0, 40))) if k % 3 else "".join(rnd.choice(words) for _ in range(4))
        text = text[:5] + "<|endoftext|>" + text[5:] if k % 40 == 0 else text
        assert mine(vocabulary, text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_words_of_every_character(library, vocabulary):
    """All of the basic plane: letters, digits, white space and signs are told apart as the library does."""
    for c in range(0x10000):
        if not 0xD800 <= c <= 0xDFFF:
            text = f"a{chr(c)}1{chr(c)} {chr(c)}!{chr(c)}"
            assert mine(vocabulary, text) == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_bpe_bounded_memory(library, monkeypatch):
    """Whatever the bounds of trie, words and pieces, the tokens are the same."""
    for name, value in (("NODES", 40), ("WORDS", 12), ("LONG", 6), ("PIECE", 5), ("SHORT", 3)):
        monkeypatch.setattr(bpe_trie, name, value)
    small = bpe_trie.Vocabulary(bpe_trie.default_vocabulary())
    rnd = random.Random(9)
    for _ in range(60):
        text = " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 12))) for _ in range(30))
        assert mine(small, text) == library.encode(text, add_special_tokens=False).ids
        assert len(small.known) <= 12 and len(small.last) <= 40 + 7


def test_bpe_shares_prefixes(vocabulary):
    """A prefix of several words is one node, worked out once."""
    vocabulary.forget()
    mine(vocabulary, " zqxjkv zqxjkvab zqxjkvac")
    mine(vocabulary, " zqxjk")
    assert len(vocabulary.last) - 1 == len(" zqxjkv") + 3


TEXTS = ["Hello world, it's 2024!\n\n  ok", "", None, "naïve 漢字 <|endoftext|>", "Hello world, it's 2024!\n\n  ok", "퟿�" + "x" * 5000, "word " * 60_000]


def test_bpe_query_columns_and_round_trip(spark, library):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    want = []
    for k, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), sha(library.decode(ids, skip_special_tokens=False))))
    assert [tuple(r) for r in bpe_trie.digest(docs).orderBy("doc_id").collect()] == want
    back = bpe_trie.decode(bpe_trie.encode(docs.select("doc_id", "text"), target="tokens").drop("text"), "tokens")
    assert [r.text for r in back.orderBy("doc_id").collect()] == [t or "" for t in TEXTS]
    assert bpe_trie.digest(docs.limit(0)).collect() == []
