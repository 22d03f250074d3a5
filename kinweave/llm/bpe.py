"""Byte-level BPE encoding and decoding with a pair occurrence index.

A partition's words that are not yet known are laid end to end as one array of symbols with links to the left and right
neighbour. The index maps each mergeable pair, by its rank, to all its positions. The lowest active rank is applied to
all its positions at once; only the lists of the pairs to the left and right of the merged symbols change, and ranks that
get positions become active. A merge makes only pairs of a higher rank (its product did not exist before it), so one
ascending pass over the active ranks gives each word the symbols that word-by-word BPE gives it.

The vocabulary is read on the driver from a path and broadcast: its size is the vocabulary's, not the data's. A partition
keeps at most CACHE words and then starts afresh.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The byte-level pre-tokeniser's pattern, a fixed value of the format. White space is spelt out as the property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CACHE = 200_000
#: Characters whose words are looked up together.
CHUNK = 2_000_000


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follows from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges, byte symbols, token bytes and added tokens of a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, vocab = _byte_chars(), spec["model"]["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        self.of_byte = np.zeros(256, np.int64)
        for token, i in vocab.items():
            self.bytes[i] = bytes(chars[c] for c in token)
            if len(token) == 1:
                self.of_byte[chars[token]] = i
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.bytes[i] = content.encode()

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, -1 where none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], -1)


def _alternate(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of a pair of equal symbols, the positions that merge from left to right without overlap."""
    taken, keep = -1, []
    for p, q in zip(at.tolist(), after[at].tolist()):
        if p != taken:
            keep.append(p)
            taken = q
    return np.array(keep, np.int64)


def encode_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All words' ids end to end, and the number of ids of each word."""
    lengths = np.array([len(w) for w in words], np.int64)
    n = int(lengths.sum()) + len(words)
    symbol = np.full(n + 1, -1, np.int64)  # -1 stands after each word
    stops = np.cumsum(lengths + 1) - 1
    inside = np.ones(n, bool)
    inside[stops] = False
    symbol[:n][inside] = v.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def note(at: np.ndarray) -> None:
        """Enter the pairs that begin at these positions."""
        rank = v.rank_of(symbol[at], symbol[after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        if len(at) > 1:
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            parts, firsts = np.split(at, cuts), rank[np.concatenate(([0], cuts))].tolist()
        else:
            parts, firsts = [at], rank.tolist()
        for r, part in zip(firsts, parts):
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(part)

    note(np.arange(n))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = v.left[r], v.right[r]
        at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
        if a == b and len(at) > 1:
            at = _alternate(np.sort(at), after)
        if not len(at):
            continue
        gone = after[at]
        symbol[at], symbol[gone] = v.product[r], -2
        beyond = after[gone]
        after[at] = beyond
        before[beyond] = at
        left = before[at]
        left = left[left >= 0]
        note(np.unique(np.concatenate((left[symbol[left] >= 0], at))))
    kept = symbol[:n] >= 0
    ends = np.cumsum(kept)[stops]
    return symbol[:n][kept].astype(np.uint32), np.diff(np.concatenate(([0], ends)))


class _Words(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Encoder:
    def __init__(self, v: Vocabulary):
        self.v, self.find = v, regex.compile(PATTERN).findall
        self.added = regex.compile("(" + "|".join(map(regex.escape, sorted(v.added, key=len, reverse=True))) + ")") if v.added else None
        self.clear()

    def clear(self) -> None:
        self.words, self.done = _Words(), 0
        self.flat, self.start, self.count = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self) -> None:
        new = list(self.words)[self.done :] if self.done else list(self.words)
        if new:
            added = self.v.added
            flat, count = encode_words([b"" if w in added else w.encode() for w in new], self.v)
            special = [i for i, w in enumerate(new) if w in added]
            if special:  # an added token is its own single id
                parts = np.split(flat, np.cumsum(count)[:-1])
                for i in special:
                    parts[i] = np.array([added[new[i]]], np.uint32)
                    count[i] = 1
                flat = np.concatenate(parts)
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(count) - count))
            self.count, self.flat = np.concatenate((self.count, count)), np.concatenate((self.flat, flat))
            self.done = len(self.words)

    def split(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self.find(text)
        out = []
        for part in self.added.split(text):
            out += [part] if part in self.v.added else self.find(part)
        return out

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > CACHE:
            self.clear()
        numbered = [np.array(list(map(self.words.__getitem__, self.split(t))), np.int64) for t in texts]
        self._learn()
        out = []
        for x in numbered:
            count = self.count[x]
            ends = np.cumsum(count)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.repeat(self.start[x] - ends + count, count) + np.arange(total)])
        return out


def _encoding(vocabulary):
    def run(batches):
        encoder = Encoder(vocabulary.value)  # a partition's words are forgotten with it
        for pdf in batches:
            texts, i = [t or "" for t in pdf["text"]], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
                    size += len(texts[j])
                    j += 1
                ids = encoder(texts[i:j])
                yield pdf.drop(columns="text").iloc[i:j].assign(ids=[x.astype("<u4").tobytes() for x in ids])
                i = j

    return run


def _decoding(vocabulary):
    def run(batches):
        table = vocabulary.value.bytes
        for pdf in batches:
            texts = [b"".join([table[i] for i in np.frombuffer(x, "<u4").tolist()]).decode("utf-8", "replace") for x in pdf["ids"]]
            yield pdf.assign(decoded=texts)

    return run


def load(spark, path: str):
    """The vocabulary at path, broadcast."""
    common.python_ready(spark)
    return spark.sparkContext.broadcast(Vocabulary(path))


def encode(docs: DataFrame, vocabulary, id_col: str = "doc_id", text_col: str = "text", *also: str) -> DataFrame:
    """doc_id, the columns also (long, without nulls), ids (binary: the token ids as little-endian unsigned 32-bit integers) for
    every row.

    Null text counts as empty and has no ids. Repeated rows and ids are encoded each on their own; other columns are
    ignored; an empty table gives an empty result. Texts are encoded whole, in chunks of documents of about CHUNK
    characters (one longer document is a chunk of its own).
    """
    plain = docs.select(common.id_in(id_col).alias("doc_id"), *also, F.col(text_col).alias("text"))
    schema = ", ".join(f"{c} long" for c in ("doc_id", *also))
    return plain.mapInPandas(_encoding(vocabulary), f"{schema}, ids binary").select(common.id_out("doc_id"), *also, "ids")


def decode(encoded: DataFrame, vocabulary) -> DataFrame:
    """encoded with the column decoded: the text of the ids, special tokens included."""
    also = encoded.columns[1:-1]
    rows = encoded.select(common.id_in("doc_id").alias("doc_id"), *also, "ids")
    schema = ", ".join(f"{c} long" for c in ("doc_id", *also))
    return rows.mapInPandas(_decoding(vocabulary), f"{schema}, ids binary, decoded string").select(common.id_out("doc_id"), *also, "ids", "decoded")


def round_trip(docs: DataFrame, path: str, *also: str) -> DataFrame:
    """doc_id, the columns also, n_tokens, ids_sha256, decoded_sha256 of every document, derived from encode() and decode()."""
    vocabulary = load(docs.sparkSession, path)
    return decode(encode(docs, vocabulary, "doc_id", "text", *also), vocabulary).select(
        "doc_id", *also,
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark, sf_dir):
    return round_trip(common.documents(spark, sf_dir), default_path())
