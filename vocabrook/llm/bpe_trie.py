"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The state of a string under BPE is its last token: the tokens of a prefix are found by cutting last tokens off, and a token
may follow the last token of what stands before it if no merge across their border would have come first. So a word's
tokens follow from one state a byte, and words that begin alike share the states of what they share. Each task inserts the
distinct words that it hasn't met yet in a trie, walks it depth first and works out the state of each new node once, from
those above it; texts are put together from their words' tokens.

Words are what the vocabulary's own pattern cuts a text into; a special token's text becomes that token, as the library
has it. The trie and the words known are kept from task to task and begun anew beyond NODES nodes or WORDS words, words of over LONG bytes
pass through a path of their own, and long texts are worked on PIECE words at a time, so that memory is bounded by the
parameters, whatever the data. Nothing is shuffled; what is broadcast is the vocabulary, whose size is that of its file.

Defined cases: a null or empty text has no tokens and decodes to an empty one; repeated rows give repeated rows; an empty
table gives no rows; other columns are not read. Bytes that are no UTF-8 are replaced as usual, when encoding and decoding.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import built_once, chunks, small_batches

#: Fixed value: the pattern of byte-level vocabularies; a space goes with the word behind it.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII characters.
ASCII_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9 \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
NODES, WORDS, LONG, PIECE, SHORT = 1 << 18, 1 << 19, 512, 1 << 16, 1 << 17


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable Latin ones for themselves, the others' bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def later_letters():
    """A pattern of the letters and digits that this Python's Unicode tables don't know yet, but the pattern library does."""
    told = regex.compile(r"[\p{L}\p{N}]")
    new = [c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn" and told.match(chr(c))]
    runs: list[list[int]] = []
    for c in new:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in runs) + "]") if runs else None


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file, with the trie of the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        known = {word: bytes(letters[c] for c in word) for word in data["model"]["vocab"]}
        self.id = {known[word]: number for word, number in data["model"]["vocab"].items()}
        self.later = later_letters()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes = {number: word for word, number in self.id.items()} | {number: text.encode() for text, number in self.special.items()}
        self.written = {number: number.to_bytes(4, "little") for number in self.bytes}
        self.sizes = {number: len(word) for number, word in self.bytes.items()}
        #: pair -> rank of its merge; token -> rank of the merge that makes it (-1: a byte) and its two parts.
        self.rank: dict[tuple[int, int], int] = {}
        self.made = dict.fromkeys(self.bytes, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = self.id[known[left]], self.id[known[right]]
            self.rank[(a, b)] = rank
            whole = self.id[known[left] + known[right]]
            if whole not in self.parts:
                self.parts[whole], self.made[whole] = (a, b), rank
        self.follow()
        self.forget()
        # a token that its own bytes don't give can't come out of an encoding
        self.id = {w: t for w, t in self.id.items() if len(w) == 1 or self.tokens(w) == [t]}
        self.follow()

    def follow(self) -> None:
        """The automaton of the tokens: a state is the longest ending of what was read that begins a token; each has the tokens that end there."""
        self.step: dict[int, int] = {}
        parent, byte, token = [0], [0], [-1]
        for word, t in self.id.items():
            at = 0
            for c in word:
                key = at << 8 | c
                at = self.step.get(key, 0)
                if not at:
                    at = self.step[key] = len(parent)
                    parent.append(key >> 8)
                    byte.append(c)
                    token.append(-1)
            token[at] = t
        depth = [0] * len(parent)
        for k in range(1, len(parent)):
            depth[k] = depth[parent[k]] + 1
        #: where to go on without a step, and the tokens (length, id) that end in a state, the longest first.
        self.fail = [0] * len(parent)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(parent)
        for k in sorted(range(1, len(parent)), key=depth.__getitem__):
            if depth[k] > 1:
                self.fail[k] = self.moved(self.fail[parent[k]], byte[k])
            own = ((depth[k], token[k]),) if token[k] >= 0 else ()
            self.ends[k] = own + self.ends[self.fail[k]]

    def moved(self, state: int, byte: int) -> int:
        step, fail = self.step, self.fail
        while (to := step.get(state << 8 | byte)) is None:
            if not state:
                return 0
            state = fail[state]
        return to

    def forget(self) -> None:
        """The trie (children; of each node the last token, the automaton's state and the prefix's ids), the words known and the pairs met, begun anew."""
        self.children: dict[int, int] = {}
        self.last: list[int] = [-1]
        self.at: list[int] = [0]
        self.ids: list[bytes] = [b""]
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def plain(self) -> dict:
        """What restored() makes the vocabulary of: dictionaries and lists, without the trie."""
        return {k: v for k, v in self.__dict__.items() if k not in ("children", "last", "at", "ids", "known", "pairs")}

    @classmethod
    def restored(cls, plain: dict) -> Vocabulary:
        self = cls.__new__(cls)
        self.__dict__.update(plain)
        self.forget()
        return self

    def may_follow(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens side by side: no merge across the border comes before those that make them.

        The merges are undone from the latest on; what is left at the border must not have been merged before that time.
        Of equal merges the left one comes first.
        """
        rank, made, parts, time = self.rank, self.made, self.parts, 1 << 60
        while True:
            r = rank.get((a, b))
            if r is not None and r < time:
                return False
            x, y = made[a], made[b]
            if x > y:
                time, a = x, parts[a][1]
            elif y >= 0:
                time, b = y + 1, parts[b][0]
            else:
                return True

    def state(self, reached: int, end: int, lasts: list[int]) -> int:
        """The last token of a prefix of `end` bytes that the automaton has read up to `reached`, from those of shorter ones (lasts)."""
        pairs = self.pairs
        for size, t in self.ends[reached]:
            if size == end:
                return t
            before = lasts[end - size]
            key = before << 32 | t
            fits = pairs.get(key)
            if fits is None:
                if len(pairs) > NODES:
                    pairs.clear()
                fits = pairs[key] = self.may_follow(before, t)
            if fits:
                return t
        raise ValueError("the vocabulary lacks a byte")

    def unwound(self, lasts: list[int]) -> list[int]:
        out, end, sizes = [], len(lasts) - 1, self.sizes
        while end:
            t = lasts[end]
            out.append(t)
            end -= sizes[t]
        out.reverse()
        return out

    def tokens(self, word: bytes) -> list[int]:
        """The tokens of one word by a path of its own."""
        lasts, reached = [-1], 0
        for end, c in enumerate(word, 1):
            reached = self.moved(reached, c)
            lasts.append(self.state(reached, end, lasts))
        return self.unwound(lasts)

    def learn(self, words: set[str]) -> None:
        """Tokens of words not known yet: in order of their bytes, the trie is walked depth first, and the path's states are at hand.

        A node also has its prefix's tokens, those of an ancestor and one more, so that nothing is unwound for a word.
        """
        children, last, reached_at, ids, step, ends, written = self.children, self.last, self.at, self.ids, self.step, self.ends, self.written
        node, lasts, before = [0] * (LONG + 1), [-1] * (LONG + 1), b""
        for word, text in sorted([(w.encode("utf-8", "replace"), w) for w in words]):
            if len(word) > LONG:
                self.known[text] = array("I", self.tokens(word)).tobytes()
                continue
            if len(last) > NODES:
                children.clear()
                del last[1:], reached_at[1:], ids[1:]
                before = b""
            shared = 0
            for x, y in zip(word, before):  # noqa: B905  (of unequal lengths)
                if x != y:
                    break
                shared += 1
            at = node[shared]
            for end in range(shared + 1, len(word) + 1):
                byte = word[end - 1]
                key = at << 8 | byte
                below = children.get(key)
                if below is None:
                    reached = step.get(reached_at[at] << 8 | byte)
                    if reached is None:
                        reached = self.moved(reached_at[at], byte)
                    size, t = ends[reached][0]
                    if size != end:
                        t = self.state(reached, end, lasts)
                        size = self.sizes[t]
                    below = children[key] = len(last)
                    last.append(t)
                    reached_at.append(reached)
                    ids.append(ids[node[end - size]] + written[t])
                node[end] = at = below
                lasts[end] = last[at]
            before = word
            self.known[text] = ids[at]

    def words(self, text: str) -> Iterator[list[str]]:
        """The words in order, in pieces: one of a text of up to SHORT characters, PIECE words each of a longer one."""
        pattern = _ASCII if text.isascii() else _WORD
        # letters and digits of later Unicode versions count as signs: the words' places are found with a sign instead
        shape = text if pattern is _ASCII or _latin(text) or not self.later else self.later.sub("!", text)
        if len(text) <= SHORT and shape == text:
            yield pattern.findall(text)
            return
        piece = []
        for m in pattern.finditer(shape):
            piece.append(text[m.start() : m.end()])
            if len(piece) == PIECE:
                yield piece
                piece = []
        if piece:
            yield piece

    def parts_of(self, text: str) -> Iterator[list[str] | bytes]:
        """A text's words in pieces, and the ids of the special tokens between them."""
        if not any(s in text for s in self.special):
            yield from self.words(text)
            return
        named = "(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
        for number, part in enumerate(re.split(named, text)):
            if number % 2:
                yield self.special[part].to_bytes(4, "little")
            else:
                yield from self.words(part)

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes]]:
        """(number of the text, token ids as little-endian 32-bit integers), in order, a text's in one row or more.

        New words are learnt for PIECE words at a time, whatever the texts that they come from.
        """
        held, size = [], 0

        def told():
            new = set().union(*[part for _, part in held if isinstance(part, list)]).difference(self.known)
            if len(self.known) + len(new) > WORDS:
                self.forget()
                new = set().union(*[part for _, part in held if isinstance(part, list)])
            self.learn(new)
            for number, part in held:
                yield number, b"".join(map(self.known.__getitem__, part)) if isinstance(part, list) else part

        for number, text in enumerate(texts):
            held.append((number, b""))
            for part in self.parts_of(text):
                held.append((number, part))
                size += len(part)
                if size >= PIECE:
                    yield from told()
                    held, size = [], 0
        yield from told()

    def encoded(self, text: str) -> bytes:
        return b"".join(ids for _, ids in self.encode_all([text]))

    def decoded(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_WORD, _ASCII = regex.compile(WORD), re.compile(ASCII_WORD)


def vocabulary(df: DataFrame, path: str | None = None):
    """The file's vocabulary, read by the driver and broadcast: its size is that of the file, whatever the data."""
    small_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast({"given": Vocabulary(path or default_vocabulary()).plain()})


def encode(df: DataFrame, column: str = "text", target: str = "ids", path: str | None = None) -> DataFrame:
    """df with the token ids of each value (array<int>; empty for null)."""
    shared = vocabulary(df, path)

    @F.pandas_udf("array<int>")
    def ids(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = built_once(shared, Vocabulary.restored)
        for texts in values:
            yield pd.Series([np.frombuffer(vocabulary.encoded(t or ""), "<i4") for t in texts], dtype=object)

    return df.withColumn(target, ids(F.col(column)))


def decode(df: DataFrame, column: str = "ids", target: str = "text", path: str | None = None) -> DataFrame:
    """df with the text of each array of token ids (empty for null)."""
    shared = vocabulary(df, path)

    @F.pandas_udf("string")
    def text(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = built_once(shared, Vocabulary.restored)
        for lists in values:
            yield pd.Series([vocabulary.decoded(np.asarray(ids, "<u4").tobytes()).decode("utf-8", "replace") if ids is not None else "" for ids in lists], dtype=object)

    return df.withColumn(target, text(F.col(column)))


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """documents -> doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded a piece of a text at a time."""
    shared = vocabulary(docs, path)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        v = built_once(shared, Vocabulary.restored)
        for pdf in chunks(batches):
            n, ids, back = [0] * len(pdf), [hashlib.sha256() for _ in range(len(pdf))], [hashlib.sha256() for _ in range(len(pdf))]
            for k, piece in v.encode_all(pdf["text"]):
                n[k] += len(piece) // 4
                ids[k].update(piece)
                # a piece ends with a word, so no character goes over its border
                back[k].update(v.decoded(piece).decode("utf-8", "replace").encode())
            out = {"doc_id": pdf["doc_id"].array, "n_tokens": n, "ids_sha256": [h.hexdigest() for h in ids], "decoded_sha256": [h.hexdigest() for h in back]}
            yield pd.DataFrame(out)

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
