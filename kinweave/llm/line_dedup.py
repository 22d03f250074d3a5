"""Line dedup over a suffix array of line sequences.

Lines that are not blank are numbered through in each document. A suffix is a line and all that follow it in its
document; its rank at length 2^k is the place of its first 2^k lines in the sorted order of all such sequences (the order
of lines is that of their MD5). Ranks double: the sequences of 2^(k+1) lines sort as the pairs of the ranks at p and at
p + 2^k, so each level sorts the distinct pairs over range partitions and numbers them through. Suffixes that share a rank
are one interval of the suffix array whose longest common prefix is at least that long; those alone in their interval
leave, since no longer prefix of theirs can repeat.

A repeated run counts from MIN_CHARS characters up, whatever its number of lines: one line of that length, or several
shorter ones. For every line the shortest run from it forward, and the one backward, that reaches this size is looked up:
its rank is the pair of the ranks of the two runs of 2^k lines that cover it, and the array is sorted as deep as these runs
need. All but the first place of such a run are later copies. The shortest runs, forward and backward, of all lines cover
just the lines of the maximal repeated runs, and these are deleted.

The first occurrence is that of the smallest (doc_id, hash of the text, line). Groupings are pre-aggregated and joins go
by line or rank, so a line that stands in a third of all documents is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Characters (of trimmed lines) from which a repeated run counts: some three words. Shorter lines repeat by chance.
MIN_CHARS = 20
DOC = ["doc_id", "h"]


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h, pos (of the line in the text), i (among lines that are not blank), line (MD5, 16 bytes), chars."""
    text = common.whole_text(text_col)
    rows = docs.select(common.id_in(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.split(text, "\n").alias("all")).select(
        *DOC, F.filter(F.transform("all", lambda x, p: F.struct(p.alias("pos"), F.trim(x).alias("line"))), lambda x: x["line"] != "").alias("all")
    )
    each = rows.select(*DOC, F.posexplode("all").alias("i", "x"))
    return each.select(*DOC, "x.pos", "i", F.unhex(F.md5(F.col("x.line").cast("binary"))).alias("line"), F.char_length("x.line").alias("chars"))


def _place():
    return F.struct(*DOC, "i")


def _ranked(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows whose key repeats, with rank (of the key among such keys, in sorted order) and first (the first place that has it).

    The intervals are written before they are sorted and joined: read again, both sides are dealt out for the join alone,
    and adaptive execution can split the partition of a key that holds a large share of the rows.
    """
    n = common.partitions(rows.sparkSession)
    shared = common.stored(rows.groupBy(*key).agg(F.min(_place()).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "intervals")
    # partitions follow one another in key order, and so do the numbers
    order = shared.repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("rank", F.monotonically_increasing_id())
    return rows.join(common.stored(order, "ranks"), key)


def _copied(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows that are not the first place of their key."""
    firsts = rows.groupBy(*key).agg(F.min(_place()).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(common.stored(firsts, "firsts"), key).where(F.col("first") != _place())


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, pos, i of every line that belongs to a later copy of a repeated run of min_chars characters or more."""
    lines = common.stored(lines_of(docs, id_col, text_col).dropDuplicates([*DOC, "i"]), "lines")
    first = _ranked(lines.select(*DOC, "i", "pos", "chars", "line"), ["line"]).select(*DOC, "i", "pos", "chars", "rank")
    doc = W.partitionBy(*DOC).orderBy("i")
    first = first.withColumn("segment", F.col("i") - F.row_number().over(doc))
    segment = W.partitionBy(*DOC, "segment").orderBy("i")
    first = first.withColumn("last", F.sum("chars").over(segment.rowsBetween(W.unboundedPreceding, 0))).withColumn("begin", F.col("last") - F.col("chars"))
    ahead = W.partitionBy(*DOC, "segment").orderBy("begin").rangeBetween(0, min_chars - 1)
    behind = W.partitionBy(*DOC, "segment").orderBy("last").rangeBetween(-(min_chars - 1), 0)
    sized = lambda w: F.when(F.sum("chars").over(w) >= min_chars, F.count("*").over(w)).cast("int")
    first = common.stored(first.withColumn("ahead", sized(ahead)).withColumn("behind", sized(behind)), "suffixes")
    runs = first.where("ahead is not null").select(*DOC, "i", F.col("ahead").alias("m")).union(
        first.where("behind is not null").select(*DOC, F.expr("i - behind + 1").alias("i"), F.col("behind").alias("m"))
    ).distinct()
    longest = first.agg(F.max(F.greatest("ahead", "behind"))).first()[0] or 0

    level, levels, size = first.select(*DOC, "i", "rank"), [], 1
    while size <= longest:
        levels.append(level.withColumn("size", F.lit(size)))
        if 2 * size <= longest:
            after = level.select(*DOC, (F.col("i") - size).alias("i"), F.col("rank").alias("next"))
            paired = level.withColumnRenamed("rank", "left").join(after, [*DOC, "i"])
            level = common.stored(_ranked(paired, ["left", "next"]).select(*DOC, "i", "rank"), "suffixes")
        size *= 2
    if not levels:
        return first.select(*DOC, "pos", "i").limit(0)
    ranks = levels[0]
    for x in levels[1:]:
        ranks = ranks.union(x)
    # the two runs of 2^k lines that cover a run of m lines begin at its own begin and at m - 2^k further on
    runs = runs.withColumn("size", F.pow(F.lit(2.0), F.floor(F.log2(F.col("m") + F.lit(0.5)))).cast("int"))
    left = ranks.withColumnRenamed("rank", "left")
    right = ranks.select(*DOC, F.col("i").alias("at"), "size", F.col("rank").alias("next"))
    covered = runs.join(left, [*DOC, "i", "size"]).withColumn("at", F.expr("i + m - size")).join(right, [*DOC, "at", "size"])
    later = _copied(covered.select(*DOC, "i", "m", "left", "next"), ["m", "left", "next"])
    marks = later.select(*DOC, F.explode(F.array(F.struct("i", F.lit(1).alias("d")), F.struct((F.col("i") + F.col("m")).alias("i"), F.lit(-1).alias("d")))).alias("x"))
    marks = marks.select(*DOC, "x.i", "x.d", F.lit(None).cast("int").alias("pos")).union(first.select(*DOC, "i", F.lit(0), "pos"))
    depth = marks.groupBy(*DOC, "i").agg(F.sum("d").alias("d"), F.max("pos").alias("pos")).withColumn("depth", F.sum("d").over(doc))
    return depth.where("depth > 0").select(*DOC, "pos", "i")


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_deleted, n_runs, longest_run, text (without later copies of repeated runs) for every row.

    Null text counts as empty and has no lines. Blank lines are never deleted and don't break a run. Rows that repeat an
    id with the same text are taken as one document, so each loses the same lines; with other texts they follow each
    other in the order of a hash of the text. Null ids come last, as one id. Texts of any length are rebuilt in time that
    grows with their lines. Extra columns are ignored, also those named like inner ones, and an empty table gives an empty
    result.
    """
    gone = repeated_lines(docs, min_chars, id_col, text_col)
    run = F.col("i") - F.row_number().over(W.partitionBy(*DOC).orderBy("i"))
    runs = gone.withColumn("run", run).groupBy(*DOC, "run").agg(F.count("*").alias("n"), F.collect_list("pos").alias("pos"))
    per = runs.groupBy(*DOC).agg(F.count("*").alias("n_runs"), F.max("n").alias("longest_run"), F.array_sort(F.flatten(F.collect_list("pos"))).alias("gone"))
    text = common.whole_text(text_col)
    rows = docs.select(common.id_in(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    lines = F.split("text", "\n")
    # one flag for each line: the deleted ones stand between runs of kept ones
    gone, last = F.col("gone"), F.size("gone") - 1
    flags = F.concat(
        F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(F.repeat(F.lit("+"), F.get(gone, i) - F.coalesce(F.get(gone, i - 1), F.lit(-1)) - 1), F.lit("-"))), ""),
        F.repeat(F.lit("+"), F.size(lines) - F.get(gone, last) - 1),
    )
    zipped = F.arrays_zip(lines.alias("line"), F.split(flags, "").alias("flag"))
    left = F.array_join(F.transform(F.filter(zipped, lambda x: x["flag"] == "+"), lambda x: x["line"]), "\n")
    kept = F.when(gone.isNull(), F.col("text")).otherwise(left)
    return rows.join(per, DOC, "left").select(
        common.id_out("doc_id"),
        F.when(F.col("text") == "", 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"),
        F.coalesce("longest_run", F.lit(0)).cast("long").alias("longest_run"),
        kept.alias("text"),
    )


def op1_line_dedup(spark, sf_dir):
    return without_repeats(common.documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_deleted", "n_runs", "longest_run", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


ORACLE = rf"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), l AS (
  SELECT doc_id, pos, trim(raw, ' ') AS line, length(trim(raw, ' ')) AS chars, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM a WHERE trim(raw, ' ') <> ''
), c AS (
  SELECT *, sum(chars) OVER (PARTITION BY doc_id ORDER BY i) AS e, sum(chars) OVER (PARTITION BY doc_id ORDER BY i) - chars AS b FROM l
), w AS (
  SELECT doc_id, i AS s, m FROM (SELECT doc_id, i, count(*) OVER v AS m, sum(chars) OVER v AS n FROM c WINDOW v AS (PARTITION BY doc_id ORDER BY b RANGE BETWEEN CURRENT ROW AND {MIN_CHARS - 1} FOLLOWING)) WHERE n >= {MIN_CHARS}
  UNION
  SELECT doc_id, i - m + 1, m FROM (SELECT doc_id, i, count(*) OVER v AS m, sum(chars) OVER v AS n FROM c WINDOW v AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN {MIN_CHARS - 1} PRECEDING AND CURRENT ROW)) WHERE n >= {MIN_CHARS}
), k AS (
  SELECT w.doc_id, w.s, w.m, string_agg(l.line, chr(10) ORDER BY l.i) AS run FROM w JOIN l ON l.doc_id = w.doc_id AND l.i BETWEEN w.s AND w.s + w.m - 1 GROUP BY ALL
), later AS (
  SELECT doc_id, s, m FROM (SELECT *, row_number() OVER (PARTITION BY run, m ORDER BY doc_id, s) AS r FROM k) WHERE r > 1
), gone AS (
  SELECT DISTINCT l.doc_id, l.pos, l.i FROM l JOIN later ON later.doc_id = l.doc_id AND l.i BETWEEN later.s AND later.s + later.m - 1
), g AS (
  SELECT doc_id, sum(n) AS n_deleted, count(*) AS n_runs, max(n) AS longest_run FROM (
    SELECT doc_id, count(*) AS n FROM (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS x FROM gone) GROUP BY doc_id, x) GROUP BY doc_id
), kept AS (
  SELECT a.doc_id, string_agg(a.raw, chr(10) ORDER BY a.pos) FILTER (gone.pos IS NULL) AS text, count(*) AS n, any_value(a.t) AS t
  FROM a LEFT JOIN gone ON gone.doc_id = a.doc_id AND gone.pos = a.pos GROUP BY a.doc_id
)
SELECT kept.doc_id, CASE WHEN t = '' THEN 0 ELSE n END AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted, coalesce(n_runs, 0) AS n_runs, coalesce(longest_run, 0) AS longest_run,
       sha256(coalesce(text, '')) AS kept_sha256
FROM kept LEFT JOIN g ON g.doc_id = kept.doc_id
"""
