"""Quality by the perplexity of an interpolated modified Kneser-Ney model of character n-grams.

One model for each language is trained on all trusted text (labelled quality 1 and not toxic). Symbols are all characters
as they are, a run of white space is one blank, and a mark stands ORDER - 1 times before each text. No alphabet is fixed
or capped: the model grows with the text.

Counting is sharded by (language, n-gram): tasks send their own sums of counts, lower orders count the distinct n-grams
of the next order, and joins of counts with their contexts' sums and with the next lower order give the probabilities.

Documents are scored by joins with these sharded tables too, no table is broadcast or sent to the driver. The pass that
counts trusted n-grams also lists those of all other text; each different one is answered once, order by order from below.
Documents are dealt, packed, into shards of about SHARD bytes of one language. A shard asks for each of its different
n-grams once, the answers are joined by n-gram and go back to the shard, which sums them up for each document. Documents
travel once: questions and sums read the same exchange.

A document is kept if its perplexity is at most the QUANTILE of that of its language's trusted documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 4
QUANTILE = 0.99
#: Bytes of text in a shard, and symbols that are coded at a time.
SHARD, PIECE = 14 << 20, 4_000_000
#: Ids of trusted documents are broadcast up to this many, 8 bytes each; beyond, they are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Tables of one row for each language are broadcast up to this many rows and joined by a shuffle beyond.
BROADCAST_LANGUAGES = 100_000
BEGIN = 0x10FFFF
#: Codes of up to this many different characters are numbers of ORDER digits; beyond, pairs are numbered first.
DIGITS = 55_000


def symbols(text: str | None) -> str:
    """The text with one blank for each run of white space, none at its ends."""
    return " ".join((text or "").split()).replace(chr(BEGIN), "�")


class Grams:
    """The ORDER-grams of some texts as numbers, in the order of the texts."""

    def __init__(self, texts: list[str]):
        marks = np.full(ORDER - 1, BEGIN, np.uint32)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        points = np.concatenate([x for t in texts for x in (marks, np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32))] or [marks])
        present = np.zeros(BEGIN + 1, bool)
        present[points] = True
        present[BEGIN] = True
        self.alphabet = np.flatnonzero(present)
        number = np.zeros(BEGIN + 1, np.int32)
        number[self.alphabet] = np.arange(len(self.alphabet), dtype=np.int32)
        self.dense = number[points]
        self.begin = len(self.alphabet) - 1
        self.pairs = None
        if len(self.alphabet) > DIGITS:
            self.pairs, at = np.unique(self._coded(self.dense, 2), return_inverse=True)
            self.pair_at = at.astype(np.int64)

    def _coded(self, d: np.ndarray, n: int) -> np.ndarray:
        out = d[: len(d) - n + 1].astype(np.int64)
        for i in range(1, n):
            out = out * len(self.alphabet) + d[i : len(d) - n + 1 + i]
        return out

    def pieces(self):
        """(first text, texts after it, codes of their n-grams), some texts at a time."""
        ends = np.cumsum(self.sizes + ORDER - 1)
        i = 0
        while i < len(self.sizes):
            begin = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, begin + PIECE, side="right")))
            d = self.dense[begin : int(ends[j - 1])]
            if self.pairs is None:
                codes = self._coded(d, ORDER) if len(d) >= ORDER else np.empty(0, np.int64)
            else:
                at = self.pair_at[begin : int(ends[j - 1]) - 1]
                codes = at[: max(0, len(at) - 2)] * len(self.pairs) + at[2:]
            yield i, j, codes[d[ORDER - 1 :] != self.begin]
            i = j

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Different codes in ascending order, and how often each occurs."""
        codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for _, _, piece in self.pieces():
            c, n = np.unique(piece, return_counts=True)
            both, at = np.unique(np.concatenate((codes, c)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, n)), len(both)).astype(np.int64)
            codes = both
        return codes, counts

    def strings(self, codes: np.ndarray) -> list[str]:
        k = len(self.alphabet)
        if self.pairs is None:
            digits = [codes // k**i % k for i in reversed(range(ORDER))]
        else:
            a, b = self.pairs[codes // len(self.pairs)], self.pairs[codes % len(self.pairs)]
            digits = [a // k, a % k, b // k, b % k]
        text = self.alphabet[np.stack(digits, 1)].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        return [text[i : i + ORDER] for i in range(0, len(text), ORDER)]


def _counted(batches):
    """lang, g, c of the texts of a task, summed up over about PIECE symbols; n-grams of other than trusted texts with 0."""
    held: dict[tuple[str, bool], list[str]] = {}

    def flushed(key):
        grams = Grams(held.pop(key))
        codes, counts = grams.distinct()
        return pd.DataFrame({"lang": key[0], "g": grams.strings(codes), "c": counts if key[1] else 0})

    for pdf in batches:
        for lang, trusted, text in zip(pdf["lang"], pdf["trusted"], pdf["text"]):
            held.setdefault((lang, trusted), []).append(symbols(text))
        for key in [x for x, texts in held.items() if sum(map(len, texts)) > PIECE]:
            yield flushed(key)
    for key in list(held):
        yield flushed(key)


def _by_language(table: DataFrame, languages: int) -> DataFrame:
    """table, of one row for each language, as a side to join: n-grams of a language are not gathered for it."""
    return F.broadcast(table) if languages <= BROADCAST_LANGUAGES else table


def kneser_ney(counts: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each order n the probabilities (lang, g, p) of n-grams and the weights (lang, ctx, w) that contexts of n - 1
    symbols leave to the next lower order, from lang, g, c of ORDER-grams. Below order 1, and for order 0 in the result, all
    symbols that the language has, and one that it hasn't, are equally likely."""
    tables = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = common.stored(tables[n + 1].groupBy("lang", F.substring("g", 2, n).alias("g")).agg(F.count("*").alias("c")), f"count-{n}")
    even = tables[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p"))
    out = {0: (common.stored(even, "even"), None)}
    languages = out[0][0].count()
    lower = out[0][0].select("lang", F.lit("").alias("g"), "p")
    for n in range(1, ORDER + 1):
        t = tables[n]
        of = t.groupBy("lang").agg(*[F.sum((F.col("c") == i).cast("long")).cast("double").alias(f"k{i}") for i in (1, 2, 3, 4)])
        y = F.coalesce(F.try_divide(F.col("k1"), F.col("k1") + 2 * F.col("k2")), F.lit(0.5))
        d = [F.least(F.lit(float(i)), F.greatest(F.lit(0.05 * i), i - (i + 1) * y * F.coalesce(F.try_divide(F.col(f"k{i + 1}"), F.col(f"k{i}")), F.lit(0.5)))) for i in (1, 2, 3)]
        of = of.select("lang", *[x.alias(f"d{i}") for i, x in enumerate(d, 1)])
        t = t.join(_by_language(of, languages), "lang").select("lang", "g", "c", F.substring("g", 1, n - 1).alias("ctx"), F.substring("g", 2, n - 1).alias("suffix"), F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"))
        contexts = common.stored(t.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("w")), f"contexts-{n}")
        below = lower.select("lang", F.col("g").alias("suffix"), F.col("p").alias("below"))
        above = contexts
        if n == 1:
            above, below = _by_language(above, languages), _by_language(below, languages)
        p = t.join(above, ["lang", "ctx"]).join(below, ["lang", "suffix"]).select("lang", "g", ((F.col("c") - F.col("d")) / F.col("total") + F.col("w") * F.col("below")).alias("p"))
        lower = common.stored(p, f"order-{n}")
        out[n] = lower, contexts.select("lang", "ctx", "w")
    return out


def answered(asked: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """lang, g, p of different ORDER-grams (lang, g): the probability where the n-gram was seen, otherwise the context's
    weight (1 for a context never seen) times the probability of the next shorter one. Languages without a model have no
    answer."""
    questions = {ORDER: asked}
    for n in range(ORDER - 1, -1, -1):
        questions[n] = questions[n + 1].select("lang", F.substring("g", 2, n).alias("g")).distinct()
    known = questions[0].join(model[0][0], "lang")
    languages = model[0][0].count()
    for n in range(1, ORDER + 1):
        seen, contexts = model[n]
        if n == 1:
            known, contexts = _by_language(known, languages), _by_language(contexts, languages)
        q = questions[n].select("lang", "g", F.substring("g", 1, n - 1).alias("ctx"), F.substring("g", 2, n - 1).alias("suffix"))
        q = q.join(known.select("lang", F.col("g").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"]).join(contexts, ["lang", "ctx"], "left")
        known = q.join(seen, ["lang", "g"], "left").select("lang", "g", F.coalesce("p", F.coalesce("w", F.lit(1.0)) * F.col("below")).alias("p"))
    return known


def _packed(batches):
    for pdf in batches:
        texts = [symbols(t) for t in pdf["text"]]
        z = [zlib.compress(t.encode("utf-8", "surrogatepass"), 6) for t in texts]
        yield pd.DataFrame({"lang": pdf["lang"], "shard": pdf["shard"], "doc_id": pdf["doc_id"], "n_symbols": [len(t) for t in texts], "z": z})


def _unpacked(z) -> Grams:
    return Grams([zlib.decompress(x).decode("utf-8", "surrogatepass") for x in z])


def _asking(key, pdf):
    grams = _unpacked(pdf["z"])
    codes = grams.distinct()[0]
    return pd.DataFrame({"lang": key[0], "shard": key[1], "at": np.arange(len(codes), dtype=np.int32), "g": grams.strings(codes)})


def _summing(key, docs, answers):
    grams = _unpacked(docs["z"])
    sums = np.full(len(docs), np.nan)
    if len(answers):
        codes = grams.distinct()[0]
        logs = np.zeros(len(codes))
        logs[answers["at"].to_numpy()] = answers["log_p"].to_numpy()
        for i, j, piece in grams.pieces():
            ends = np.cumsum(grams.sizes[i:j])
            held = np.flatnonzero(grams.sizes[i:j])
            if len(held):
                sums[i + held] = np.add.reduceat(logs[np.searchsorted(codes, piece)], (ends - grams.sizes[i:j])[held])
    return pd.DataFrame({"doc_id": docs["doc_id"], "lang": docs["lang"], "n_symbols": docs["n_symbols"], "log_p": sums})


def scored(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """doc_id, lang, n_symbols, log_p of every document, by models of all trusted text; log_p is null without a model of the
    language, or without a symbol."""
    spark = docs.sparkSession
    common.python_ready(spark)
    text = common.whole_text(text_col)
    plain = docs.select(common.id_in(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), text.alias("text"))
    ids = trusted_ids(labels)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    told = plain.join(ids.withColumn("t", F.lit(True)), "doc_id", "left").select("lang", F.coalesce("t", F.lit(False)).alias("trusted"), "text")
    grams = common.stored(told.mapInPandas(_counted, "lang string, g string, c long").groupBy("lang", "g").agg(F.sum("c").alias("c")), "grams")
    model = kneser_ney(grams.where("c > 0"))
    answers = common.stored(answered(grams.select("lang", "g"), model), "answers")
    shards = max(1, -(-(plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD))
    dealt = plain.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))
    packed = dealt.mapInPandas(_packed, "lang string, shard long, doc_id long, n_symbols long, z binary")
    packed = packed.repartition(max(common.partitions(spark), 2 * shards), "lang", "shard")
    asked = packed.groupBy("lang", "shard").applyInPandas(_asking, "lang string, shard long, at int, g string")
    back = asked.join(answers, ["lang", "g"]).select("lang", "shard", "at", F.log("p").alias("log_p"))
    out = packed.groupBy("lang", "shard").cogroup(back.groupBy("lang", "shard")).applyInPandas(_summing, "doc_id long, lang string, n_symbols long, log_p double")
    return out.withColumn("log_p", F.nanvl("log_p", F.lit(None)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()


def classified(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, **columns) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, kept for every row of docs.

    Null lang is a language of its own, the empty name. Texts without a symbol (null, empty, only white space) have no
    perplexity and aren't kept. Documents of a language without trusted text have neither perplexity nor threshold and are
    kept. Rows are judged each by its own text, whatever other rows have its id; null ids are never trusted. Texts are read
    whole; a very long one takes a shard of its size. Extra columns are ignored, also those named like inner ones; an empty
    table gives an empty result.
    """
    out = scored(docs, labels, **columns).withColumn("perplexity", F.exp(-F.col("log_p") / F.nullif("n_symbols", F.lit(0))))
    out = common.stored(out, "perplexities")
    trusted = out.join(trusted_ids(labels), "doc_id", "left_semi").where("perplexity is not null")
    cuts = trusted.groupBy("lang").agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("threshold"))
    cuts = common.stored(cuts, "thresholds")
    return out.join(_by_language(cuts, cuts.count()), "lang", "left").select(
        common.id_out("doc_id"), "lang", "n_symbols", "perplexity", "threshold",
        ((F.col("n_symbols") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).alias("kept"),
    )


def op7_quality_classifier(spark, sf_dir):
    return classified(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
