"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is cut, from left to right,
into the longest phrases that the automaton reads from its root. A phrase is a pointer into the training text, so it
costs the logarithm of that text's length; the language whose phrases cost the fewest bits wins. Languages may thus
differ in how much text they have, and a label with little text changes no other language's automaton.

Bounds (they concern the fit only): SAMPLE_ROWS labelled rows of each language whose text has a letter, chosen by a hash of the id, and of these
pieces, chosen by a hash as well, up to TRAIN_CHARS characters in all for a language (less if there are so many
languages that the automata of all would pass TOTAL_CHARS). Every text is parsed whole. The broadcast holds the sampled
text, at most TOTAL_CHARS characters; workers build the automata from it.

Many texts are parsed in lockstep: texts are laid out in pieces of PIECE symbols and one vectorised step advances all pieces
in all automata by one symbol. A phrase ends with its piece, which adds at most one phrase a piece in each language, about 1
in 150; the tests hold counts to this bound, and languages to those of texts parsed in one piece.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

SAMPLE_ROWS = 200
SAMPLE_PIECE = 400
TRAIN_CHARS = 20_000
TOTAL_CHARS = 400_000
PIECE = 1024
#: Symbols parsed at a time.
CHUNK = 2_000_000
LETTERS = 60
UNDETERMINED = "und"
END, BLANK, OTHER, FIRST = 0, 1, 2, 3


def learnable(id_col: str = "doc_id"):
    """Rows that may be learnt from: crc32 of the id as text leaves a remainder other than 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(True))


def training_text(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> dict[str, str]:
    """The bounded sample: up to TRAIN_CHARS characters of pieces for each label, on the driver."""
    usable = docs.where(learnable(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = usable.select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h")
    )
    picked = rows.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "id"))).where(F.col("r") <= SAMPLE_ROWS)
    sample = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(picked.select("id").distinct(), "id", "left_semi")
    starts = F.sequence(F.lit(0), F.floor(F.char_length("text") / SAMPLE_PIECE).cast("int"))
    pieces = sample.select("id", "lang", "text", F.explode(starts).alias("at")).select(
        "lang", F.expr(f"substring(text, at * {SAMPLE_PIECE} + 1, {SAMPLE_PIECE})").alias("piece"), F.xxhash64("id", "at").alias("h")
    )
    top = pieces.where(F.col("piece").rlike(r"\p{L}")).withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "piece")))
    found: dict[str, list[str]] = {}
    for lang, piece in top.where(F.col("r") <= TRAIN_CHARS // SAMPLE_PIECE * 2).orderBy("lang", "r").select("lang", "piece").collect():
        found.setdefault(lang, []).append(piece)
    budget = max(1, min(TRAIN_CHARS, TOTAL_CHARS // max(1, len(found))))
    return {lang: " ".join(pieces)[:budget] for lang, pieces in found.items()}


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions [state, symbol] of the suffix automaton of the sequence, -1 where none."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    table = np.full((len(nxt), width), -1, np.int32)
    for state, out in enumerate(nxt):
        for c, to in out.items():
            table[state, c] = to
    return table


class CrossParser:
    """Phrase counts of texts against the suffix automata of labelled texts."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        lowered = [texts[x].lower() for x in self.langs]
        chars, counts = np.unique(np.concatenate([self._points(t) for t in lowered] or [np.empty(0, np.uint32)]), return_counts=True)
        letters = [(-n, c) for c, n in zip(chars.tolist(), counts.tolist()) if chr(c).isalpha()]
        known = [c for _, c in sorted(letters)[: LETTERS * max(1, len(self.langs))]][: 255 - FIRST]
        self.table = np.full(0x110000, BLANK, np.uint8)
        self.table[[c for c in range(0x110000) if chr(c).isalpha()]] = OTHER
        for i, c in enumerate(known):
            self.table[c] = FIRST + i
        self.width = FIRST + len(known)
        trained = [self.symbols(t).tolist() for t in lowered]
        tables = [automaton(t, self.width) for t in trained]
        #: Bits of a phrase in each language: where it stands in the training text.
        self.bits = np.log2([max(2, len(t)) for t in trained])
        self.base = np.cumsum([0, *map(len, tables)])[:-1].astype(np.int64)
        roots = [np.maximum(t[0], 0) + b for t, b in zip(tables, self.base)]
        self.absent = np.stack([t[0] < 0 for t in tables]) if tables else np.empty((0, self.width), bool)
        self.root = np.stack(roots) if roots else np.empty((0, self.width), np.int64)
        self.next = np.concatenate([np.where(t < 0, -1, t + b) for t, b in zip(tables, self.base)]).astype(np.int32) if tables else None
        if tables:
            for x in (self.next, self.root):
                x[:, END] = 0
            self.next = self.next.ravel()

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def symbols(self, text: str) -> np.ndarray:
        """Letters by number, every run of other characters as one blank."""
        x = self.table[self._points(text)]
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != BLANK) | (x[:-1] != BLANK)
        return x[keep]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """[text, language]: phrases that end where the automaton can't read on."""
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // PIECE) for t in texts])
        pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if not pieces or not len(self.langs):
            return out
        sizes = np.array([len(p) for p in pieces])
        order = np.argsort(-sizes, kind="stable")
        grid = np.zeros((int(sizes.max()), len(pieces)), np.uint8)
        for col, i in enumerate(order):
            grid[: sizes[i], col] = pieces[i]
        running = np.searchsorted(-sizes[order], -np.arange(1, len(grid) + 1), side="right")
        langs = len(self.langs)
        state = np.repeat(self.base[:, None], len(pieces), 1)
        missed = np.zeros((langs, len(pieces)), np.int32)
        for j, n in enumerate(running):
            c = grid[j, :n]
            to = self.next[state[:, :n] * self.width + c]
            stop = to < 0
            # a symbol that the automaton doesn't have is a phrase of its own, and ends the one before it
            missed[:, :n] += stop
            missed[:, :n] += stop & self.absent[:, c] & (state[:, :n] != self.base[:, None])
            state[:, :n] = np.where(stop, self.root[:, c], to)
        np.add.at(out, owner[order], missed.T)
        return out

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text: score is by what share fewer bits the winner's phrases need than the runner-up's."""
        coded = [self.symbols((t or "").lower()) for t in texts]
        found = []
        for x, counts in zip(coded, self.phrases(coded)):
            if not len(self.langs) or not (x >= OTHER).any():
                found.append((UNDETERMINED, 0.0))
                continue
            cost = (counts + 1) * self.bits
            best = int(cost.argmin())
            second = min((float(n) for i, n in enumerate(cost) if i != best), default=0.0)
            found.append((self.langs[best], 1.0 if not second else float(second - cost[best]) / second))
        return found


_parsers: dict[str, CrossParser] = {}


def _predicting(texts):
    def run(batches):
        key = hashlib.sha256(repr(sorted(texts.value.items())).encode()).hexdigest()
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = CrossParser(texts.value)
        parse = _parsers[key]
        for pdf in batches:
            rows, i = pdf["text"].tolist(), 0
            while i < len(rows):
                j, size = i, 0
                while j < len(rows) and (j == i or size + len(rows[j] or "") <= CHUNK):
                    size += len(rows[j] or "")
                    j += 1
                found = parse(rows[i:j])
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[i:j].array, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})
                i = j

    return run


def identify(docs: DataFrame, texts: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    texts: labelled text by language; by default training_text(docs). A text that is null or has no letter is `und` with
    score 0, as is every text if nothing could be learnt. Ties go to the language that sorts first, with score 0.
    Repeated rows, and rows without an id, are each predicted; texts of any length are parsed whole; extra columns are
    ignored, also those named like inner ones; an empty table gives an empty result.
    """
    common.python_ready(docs.sparkSession)
    texts = training_text(docs, id_col, text_col) if texts is None else texts
    shared = docs.sparkSession.sparkContext.broadcast(texts)
    plain = docs.select(common.id_in(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = plain.mapInPandas(_predicting(shared), "doc_id long, lang_pred string, score double")
    return out.select(common.id_out("doc_id"), "lang_pred", "score").select("doc_id", (~learnable("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose language can't be told (und), all columns as they were. A row goes by its own text,
    whatever other rows have its id."""
    key = common.row_key(id_col, text_col)
    keyed = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    found = identify(keyed, training_text(docs, id_col, text_col), "key").where(F.col("lang_pred") == UNDETERMINED)
    return common.without(docs, found.select(common.id_in("doc_id").alias("__out")).distinct(), key)


def op2_language_id(spark, sf_dir):
    return identify(common.documents(spark, sf_dir))
