"""Exact dedup by a tree-merge of sorted digest runs.

Every document becomes (digest, length check, code points, doc_id). Rows are dealt to R runs; a run is sorted by digest
and holds one entry for each digest: its best row and its count. Runs are then merged in rounds, FAN_IN at a time: in
round r the runs whose numbers agree above the lowest r * BITS bits meet, shard by shard of the digest, and a streaming
sort-merge keeps for each digest the best row and the sum of the counts. After the last round one entry is left for
each digest. No task ever sees more than FAN_IN entries of one digest (a run's own rows are combined before they are
sent), so a text that fills a third of the table costs no more than any other.

The way back is the same tree: the winners join the entries of the runs, and these join the documents by (digest, run),
so that the rows of a hot digest stay dealt over all R runs.

Verified: entries are equal only if SHA-256, the length and an independent 64-bit hash of the normalised text agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 3
FAN_IN = 1 << BITS


def normalised(text: Column) -> Column:
    """The text without every character of [\\x20\\x09-\\x0D]."""
    return F.translate(text, common.SPACES, "")


def run_count(spark) -> int:
    """A power of two near the session's shuffle partitions: the runs grow with the cluster's own setting."""
    return 1 << max(BITS, (common.partitions(spark) - 1).bit_length())


def digests(docs: DataFrame, runs: int, id_col: str = "doc_id", text_col: str = "text", own: tuple[Column, ...] = ()) -> DataFrame:
    text = common.whole_text(text_col)
    norm = docs.select(
        common.id_in(id_col).alias("doc_id"), *own, F.char_length(text).cast("long").alias("n_cp"), normalised(text).alias("norm")
    )
    return norm.select(
        *norm.columns[:-1],
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.struct(F.octet_length("norm").alias("n_bytes"), F.xxhash64("norm").alias("h")).alias("proof"),
        F.pmod(F.xxhash64("doc_id", "n_cp"), F.lit(runs)).cast("int").alias("run"),
    )


def _merged(entries: DataFrame, run: Column, n: Column) -> DataFrame:
    """One sorted run for each value of run: entries meet by (run, shard of the digest) and merge in digest order."""
    keyed = entries.select(run.alias("run"), F.substring("digest", 1, 2).alias("shard"), "digest", "proof", "best", n.alias("n"))
    return (
        keyed.groupBy("run", "shard", "digest", "proof")
        .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        .select("run", "digest", "proof", "best", "n")
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs, dropped ones too.

    Of rows with equal normalised text the one with the most code points, then the smallest id, stays. Null text counts
    as empty, and all empty texts are one group. Repeated rows with one id form a group of their own size and are all
    reported; with equal text all of them have kept = true if the id stays. Null ids are one id, the last. Other columns
    are ignored, also those named like inner ones. Whole texts of any length are hashed. An empty table gives an empty result.
    """
    base, down = _grouped(docs, id_col, text_col)
    return base.join(down, ["digest", "proof", "run"]).select(
        common.id_out("doc_id"),
        common.id_out("keep_id"),
        "group_size",
        (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _grouped(docs: DataFrame, id_col: str, text_col: str, *own: Column) -> tuple[DataFrame, DataFrame]:
    """The digests of docs, with the columns own, and keep_id, group_size and own's keep_... by (digest, proof, run)."""
    runs = run_count(docs.sparkSession)
    base = common.stored(digests(docs, runs, id_col, text_col, own), "digests")
    more = base.columns[1 : 1 + len(own)]
    first = _merged(
        base.withColumn("best", F.struct((-F.col("n_cp")).alias("neg_cp"), "doc_id", *more)), F.col("run"), F.lit(1).cast("long")
    )
    tree, left = first, runs
    while left > 1:
        left = max(1, left >> BITS)
        tree = _merged(tree, F.col("run") % left, F.col("n"))
    winners = tree.select("digest", "proof", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), *[F.col(f"best.{c}").alias(f"keep_{c}") for c in more])
    return base, first.select("digest", "proof", "run").join(winners, ["digest", "proof"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the later copies, all columns as they were. Rows are told apart by id and text; of equal rows one stays."""
    key = common.row_key(id_col, text_col)
    base, down = _grouped(docs, id_col, text_col, key.alias("key"))
    out = base.join(down, ["digest", "proof", "run"]).where("key <> keep_key").select(F.col("key").alias("__out")).distinct()
    return common.without(docs, out, key, common.repeated_keys(base))


def op5_exact_dedup(spark, sf_dir):
    return exact_duplicates(common.documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
