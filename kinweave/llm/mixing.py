"""Mixing sources to target weights by Pfair scheduling.

Each source is a stream of blocks of BLOCK_ROWS rows, in the order of a hash of the id. A source of weight w (m of Q
slots) gives its block j (from 0) the release time floor(j / w) and the deadline ceil((j + 1) / w). In each slot the
released block with the earliest deadline goes next. With weights that sum to one this keeps every source within less
than one block of its share at any time, as long as no source has run out; later blocks keep the slots of their windows,
so nothing is dropped.

The schedule repeats after Q slots, where every source has had exactly its m blocks. So only one period is scheduled, by
a fold over Q slots, and block j of a source gets the slot (j div m) * Q + slot of block (j mod m). Q is RESOLUTION, or as
often twice that as gives the smallest weight LEAST slots, times that one of FACTORS which leaves the least to round; m are
the weights times Q, rounded to whole numbers of the sum Q by largest remainders. Weights of three decimals, and mostly of
four, are thus met exactly, others to less than one block a period.

A fold costs Q times the number of sources. Beyond FANOUT sources it has two levels: the larger half of FANOUT sources and
the groups that the others are dealt to share the period, and each group's slots are shared by its members in the same way,
one fold for each group. A member is then within one block and its share of the group (under half a block) of its share.

Ranks within a source come from counts of (source, hash prefix) groups and a window within such a group: a source that holds
a third of all rows is spread over all hash prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

BLOCK_ROWS = 32
RESOLUTION, LEAST, FACTORS = 1000, 4, 10
FANOUT = 1000
#: The period's table is broadcast up to this many rows and joined by a shuffle beyond.
BROADCAST_ROWS = 50_000
#: Slots of sources of weight zero, which follow all others, begin here.
AFTER = 1 << 40


def target_weights(counts: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """source, w of every source in counts (source, n). Without weights, the square root of n is the weight; with weights,
    sources that are not named have none."""
    if weights is None:
        return counts.select("source", F.sqrt("n").alias("w"))
    named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
    return counts.select("source", F.greatest(F.coalesce(F.try_element_at(named, F.col("source")).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("w"))


def slots(weights: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """grp, source, m, q from grp, source, w (above zero): m of the q slots of the group's period."""
    all_, least = F.sum("w").over(W.partitionBy("grp")), F.min("w").over(W.partitionBy("grp"))
    twice = F.greatest(F.lit(0), F.ceil(F.log2(LEAST * F.col("all") / (resolution * F.col("least")))))
    x = weights.withColumn("all", all_).withColumn("least", least).withColumn("q", (resolution * F.pow(F.lit(2.0), twice)).cast("long"))
    tried = x.select("grp", "source", F.explode(F.transform(F.sequence(F.lit(1), F.lit(FACTORS)), lambda c: F.struct(c.alias("c"), (c * F.col("q")).alias("q"), F.round(c * F.col("q") * F.col("w") / F.col("all"), 6).alias("x")))).alias("t"))
    tried = tried.select("grp", "source", "t.*")
    left = tried.groupBy("grp", "c").agg(F.max(F.round(F.abs(F.col("x") - F.round("x")), 6)).alias("left"))
    best = left.groupBy("grp").agg(F.min(F.struct("left", "c"))["c"].alias("c"))
    x = tried.join(best, ["grp", "c"]).withColumn("whole", F.floor("x"))
    place = F.row_number().over(W.partitionBy("grp").orderBy(F.desc(F.col("x") - F.col("whole")), "source"))
    more = place <= F.col("q") - F.sum("whole").over(W.partitionBy("grp"))
    return x.select("grp", "source", (F.col("whole") + more.cast("long")).alias("m"), "q")


def period(shares: DataFrame) -> DataFrame:
    """grp, source, m, q, i, at from grp, source, m: the slot (from 0) of block i of each source in one period of its group.
    One row for each group goes through the fold."""
    lists = shares.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("source", "m"))).alias("s"), F.sum("m").alias("q"))
    pick = """
        array_min(transform(sequence(0, size(s) - 1), i -> if(
            acc.c[i] < s[i].m and acc.c[i] * q div s[i].m <= t,
            cast(-((-(acc.c[i] + 1) * q) div s[i].m) + if(((acc.c[i] + 1) * q) % s[i].m = 0, 0, 1) as bigint) * 1000000 + i,
            null)))"""
    # div truncates, so the ceiling is the quotient and one more where a remainder is left. Slots are picked in chunks, so
    # that the list of picks isn't copied whole for each of them
    step = f"""
        (acc, t) -> transform(array(cast({pick} % 1000000 as int)), k -> named_struct(
            'c', transform(acc.c, (v, i) -> if(i = k, v + 1, v)),
            'out', concat(acc.out, array(k))))[0]"""
    folded = lists.withColumn("picks", F.expr(f"""
        aggregate(sequence(0L, (q - 1) div 512),
            named_struct('c', transform(s, x -> 0L), 'out', cast(array() as array<array<int>>)),
            (all, chunk) -> transform(array(
                aggregate(sequence(chunk * 512, least(q, (chunk + 1) * 512) - 1), named_struct('c', all.c, 'out', cast(array() as array<int>)), {step})),
                part -> named_struct('c', part.c, 'out', concat(all.out, array(part.out))))[0],
            all -> flatten(all.out))"""))
    picked = folded.select("grp", "s", "q", F.posexplode("picks").alias("at", "k")).select("grp", F.expr("s[k].source").alias("source"), F.expr("s[k].m").alias("m"), "q", F.col("at").cast("long"))
    return picked.withColumn("i", F.row_number().over(W.partitionBy("grp", "source").orderBy("at")).cast("long") - 1)


def _grouped(weights: DataFrame) -> DataFrame:
    """source, w, grp: the heavier half of FANOUT sources alone, the others dealt to as many groups in the order of weights."""
    half = FANOUT // 2
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("w"), "source")) - 1
    return weights.withColumn("place", place).select("source", "w", F.when(F.col("place") < half, F.col("place")).otherwise(half + F.col("place") % half).cast("string").alias("grp"))


def _placed(rows: DataFrame, times: DataFrame, key: str, block: str, slot: str) -> DataFrame:
    """rows with slot, that of the block number in the period of the source named by key."""
    sizes = times.groupBy("source").agg(F.max("m").alias("m"), F.max("q").alias("q")).withColumnRenamed("source", key)
    at = times.select(F.col("source").alias(key), "i", "at")
    few = times.count() <= BROADCAST_ROWS
    out = rows.join(F.broadcast(sizes) if few else sizes, key).withColumn("i", F.col(block) % F.col("m"))
    out = out.join(F.broadcast(at) if few else at, [key, "i"])
    return out.withColumn(slot, F.expr(f"{block} div m") * F.col("q") + F.col("at")).drop("i", "m", "q", "at")


def mixed(
    docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, resolution: int = RESOLUTION,
    id_col: str = "doc_id", source_col: str = "source",
) -> DataFrame:
    """docs with mix_block, mix_slot, mix_row (the row's place in its block); the mixture is the order (mix_slot, mix_row).

    Every row is kept, repeated rows included. Null sources count as one source, the empty name. Sources of weight zero
    follow all others, in turn. Rows of one id, and those without an id, follow in the order of a hash of all their
    columns; equal rows stand side by side. Columns of docs named like the three are replaced, others may have any name;
    texts pass through as they are. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = ["mix_block", "mix_slot", "mix_row"]
    kept = [c for c in docs.columns if c not in own]
    digits = 1
    while 16**digits < common.partitions(spark):
        digits += 1
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("h"),
        F.col(id_col).alias("id"),
        F.xxhash64(*[F.col(f"`{c}`") for c in kept]).alias("tie"),
    ).withColumn("part", F.substring("h", 1, digits))
    groups = rows.groupBy("source", "part").agg(F.count("*").alias("n"))
    given = common.stored(target_weights(groups.groupBy("source").agg(F.sum("n").alias("n")), weights), "weights")
    real = given.where("w > 0")
    before = groups.select(
        "source", "part", (F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before")
    )
    rest = given.where("w = 0").select("source", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("source")) - 1).cast("long").alias("turn"))
    turns = rest.count()
    starts = before.join(rest, "source", "left")
    ranked = (
        rows.withColumn("r", F.row_number().over(W.partitionBy("source", "part").orderBy("h", "id", "tie")) - 1)
        .join(starts, ["source", "part"])
        .withColumn("rank", F.col("before") + F.col("r"))
        .select("row", "source", "turn", F.floor(F.col("rank") / block_rows).cast("long").alias("mix_block"), (F.col("rank") % block_rows).cast("int").alias("mix_row"))
    )
    timed = ranked.where("turn is null")
    if real.count() <= FANOUT:
        times = common.stored(period(slots(real.withColumn("grp", F.lit("")), resolution)), "period")
        timed = _placed(timed, times, "source", "mix_block", "mix_slot")
    else:
        members = common.stored(_grouped(real), "groups")
        inner = common.stored(period(slots(members, resolution)), "period")
        outer = members.groupBy(F.col("grp").alias("source")).agg(F.sum("w").alias("w")).withColumn("grp", F.lit(""))
        outer = common.stored(period(slots(outer, resolution)), "period")
        timed = _placed(timed, inner, "source", "mix_block", "turn_in_group")
        timed = timed.join(members.select("source", "grp"), "source")
        timed = _placed(timed, outer, "grp", "turn_in_group", "mix_slot")
    out = timed.select("row.*", "mix_block", "mix_slot", "mix_row")
    if turns:
        last = ranked.where("turn is not null").withColumn("mix_slot", F.lit(AFTER) + F.col("mix_block") * turns + F.col("turn"))
        out = out.union(last.select("row.*", "mix_block", "mix_slot", "mix_row"))
    return out


def written_place() -> Column:
    """Of rows read from files that in_mixed_order() was written to: a number that orders them as the mixture does (the
    writer's partition, its file, the row in it)."""
    part = lambda i: F.regexp_extract("_metadata.file_name", r"part-([0-9]+)-.*-c([0-9]+)", i).cast("long")
    return F.shiftleft(part(1), 44) + F.shiftleft(part(2), 34) + F.col("_metadata.row_index")


def in_mixed_order(docs: DataFrame, **kwargs) -> DataFrame:
    """docs, every row and column, sorted over all partitions into the mixture's order. Written to files, they keep it: see
    written_place()."""
    out = mixed(docs, **kwargs)
    n = common.partitions(docs.sparkSession)
    return out.repartitionByRange(n, "mix_slot", "mix_row").sortWithinPartitions("mix_slot", "mix_row").select([F.col(f"`{c}`") for c in docs.columns])


def op3_mix_sources(spark, sf_dir):
    docs = common.documents(spark, sf_dir).select("doc_id", "source")
    return mixed(docs).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "mix_block", "mix_slot", "mix_row")


ORACLE = f"""
WITH RECURSIVE n AS (
  SELECT coalesce(source, '') AS source, sqrt(count(*)) AS w FROM documents GROUP BY 1
), tot AS (
  SELECT sum(w) AS total, CAST({RESOLUTION} * pow(2, greatest(0, ceil(log2({LEAST} * sum(w) / ({RESOLUTION} * min(w)))))) AS BIGINT) AS slots FROM n
), tried AS (
  SELECT source, c, c * slots AS slots, round(c * slots * w / total, 6) AS x FROM n, tot, range(1, {FACTORS + 1}) AS f(c)
), x AS (
  SELECT source, CAST(slots AS BIGINT) AS slots, x FROM tried WHERE c = (SELECT min({{e: e, c: c}}).c FROM (SELECT c, max(round(abs(x - round(x)), 6)) AS e FROM tried GROUP BY c))
), m AS (
  SELECT source, CAST(floor(x) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, source) <= slots - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS m FROM x
), s AS (
  SELECT list(source ORDER BY source) AS names, list(m ORDER BY source) AS ms, CAST(sum(m) AS BIGINT) AS q FROM m
), sim AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(ms, lambda x: CAST(0 AS BIGINT)) AS c, CAST(0 AS BIGINT) AS k FROM s
  UNION ALL
  SELECT t + 1, list_transform(c, lambda v, i: CASE WHEN i = pick THEN v + 1 ELSE v END), pick
  FROM (
    SELECT t, c, list_min(list_transform(c, lambda v, i: CASE WHEN v < ms[i] AND (v * q) // ms[i] <= t + 1
             THEN (((v + 1) * q + ms[i] - 1) // ms[i]) * 1000000 + i END)) % 1000000 AS pick
    FROM sim, s WHERE t + 1 < q)
), p AS (
  SELECT names[k] AS source, ms[k] AS m, q, t, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i FROM sim, s WHERE t >= 0
), r AS (
  SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank FROM documents
), sz AS (SELECT source, max(m) AS m, max(q) AS q FROM p GROUP BY 1)
SELECT r.doc_id, r.source, CAST(rank // {BLOCK_ROWS} AS BIGINT) AS mix_block,
       CAST((rank // {BLOCK_ROWS}) // sz.m * sz.q + p.t AS BIGINT) AS mix_slot, CAST(rank % {BLOCK_ROWS} AS INTEGER) AS mix_row
FROM r JOIN sz USING (source) JOIN p ON p.source = r.source AND p.i = (rank // {BLOCK_ROWS}) % sz.m
"""
