"""Candidate generation: blocks as data, one plan for all of them.

A Block says which keys a target is filed under, which keys a query looks up, and the limits. All blocks of a run are
stacked in one relation (block, key), so that filing, pruning by document frequency, capping and lookup are one group-by
and one equi-join on (source, country, block, key) each, however many blocks there are. Keys that are too frequent leave
by a pre-aggregated count before any list is ordered or joined, so common words never form large groups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import config
from ..functions import text as X

Keys = Callable[[], Column]


def _long(words: Column, n: int) -> Column:
    return F.filter(words, lambda t: F.length(t) >= n)


def _one(key: Column) -> Column:
    return F.filter(F.array(key), lambda k: k != "")


def _name_tokens() -> Column:
    return _long(F.col("name_tokens"), 3)


def _plain_tokens() -> Column:
    """Name tokens of three characters or more that aren't legal words."""
    return F.filter(_name_tokens(), lambda t: ~t.isin(config.LEGAL_STOPWORDS))


def _address_words(words: Column) -> Column:
    return F.filter(words, lambda t: (F.length(t) >= 4) & ~t.rlike(r"^\p{Nd}+$"))


def _grams() -> Column:
    return X.tokens(F.col("name_char_3gram"))


def _with_first(part: str, sep: str, words: Column) -> Column:
    """part, sep and the first word, if both exist."""
    first = F.try_element_at(words, F.lit(1))
    return F.when((F.col(part) != "") & first.isNotNull(), F.array(F.concat(F.col(part), F.lit(sep), first))).otherwise(F.array().cast("array<string>"))


def _housed(words: Column, prefix: str = "") -> Column:
    return F.when(F.col("house_number") != "", F.transform(words, lambda t: F.concat(F.lit(prefix), F.col("house_number"), F.lit("_"), t))).otherwise(F.array().cast("array<string>"))


def _house_tokens() -> Column:
    names = F.slice(_plain_tokens(), 1, 4)
    ways = F.slice(_address_words(F.col("address_tokens")), 1, 2)
    return F.concat(_housed(names), _housed(ways, "addr_"))


def _web() -> Column:
    return F.col("name_web_collapsed")


def _col(name: str) -> Keys:
    return lambda: _one(F.col(name))


@dataclass(frozen=True)
class Block:
    """index: name of the postings (blocks that share an index share its postings); ratio: largest share of the N targets
    a key may have, N being the pool or those registered in the index; cap: longest list; limit: candidates of a query
    and source; count: take the limit by shared keys instead of key order; rare: look up only that many rarest keys."""

    name: str
    targets: Keys
    queries: Keys
    least: int = 2
    ratio: float = 0.01
    registered: bool = False
    cap: int = 1000
    limit: int | Keys | None = 50
    count: bool = False
    rare: int | None = None
    index: str = ""

    @property
    def filed(self) -> str:
        return self.index or self.name


def _gram_block(name: str, limit) -> Block:
    return Block(name, lambda: F.array_distinct(_grams()), lambda: F.array_distinct(_grams()), 3, 0.05, cap=1000, limit=limit, count=True, index="char_3gram")


def _boosted() -> Column:
    return F.when(F.length("name_norm") >= 8, 35).otherwise(10)


_TOKENS = dict(targets=lambda: F.array_distinct(_name_tokens()), queries=_name_tokens, least=3, ratio=0.005, cap=500, index="name_token")
RESEARCH = {
    b.name: b
    for b in [
        Block("exact_name", _col("name_norm"), _col("name_norm"), limit=None),
        Block("name_core", _col("name_core"), _col("name_core"), limit=None),
        Block("name_token", **_TOKENS),
        Block("rare_token", **_TOKENS, rare=2),
        *(_gram_block(f"char_3gram_k{k}", k) for k in (5, 10, 20, 50)),
        Block("postal", _col("postal_code"), _col("postal_code"), least=4, cap=500),
        Block("house_name", lambda: _with_first("house_number", "#", _name_tokens()), lambda: _with_first("house_number", "#", _name_tokens()), cap=200),
        Block("address_token", lambda: F.array_distinct(_address_words(F.col("address_tokens"))), lambda: _address_words(F.col("address_tokens")), 4, 0.002, cap=300, limit=30),
        Block("combined_postal_name", lambda: _with_first("postal_code", "#", _name_tokens()), lambda: _with_first("postal_code", "#", _name_tokens()), cap=200),
        Block("name_web_norm", lambda: _one(_web()), lambda: F.filter(_one(_web()), lambda k: F.length(k) >= 4), ratio=0.005, registered=True, cap=500),
        Block("name_core_v2", _col("name_core_v2"), _col("name_core_v2"), ratio=0.005, registered=True, cap=500),
        Block("house_token", _house_tokens, _house_tokens, ratio=0.005, registered=True, cap=500),
        _gram_block("char_3gram_adaptive", _boosted),
    ]
}


@dataclass(frozen=True)
class FastBlock:
    """A block without pruning: the first cap postings of a key, the first limit lookups of a query, repeats counted."""

    name: str
    targets: Keys
    queries: Keys
    least: int
    cap: int
    limit: int


def _web_of_norm() -> Column:
    return _one(X.name_web_collapsed(F.col("name_norm"), unicode=False))


FAST = {
    b.name: b
    for b in [
        FastBlock("exact_name", _col("name_norm"), _col("name_norm"), 2, 500, 50),
        FastBlock("name_core", _col("name_core"), _col("name_core"), 2, 500, 50),
        FastBlock("rare_token", lambda: F.slice(_plain_tokens(), 1, 3), lambda: F.slice(_plain_tokens(), 1, 2), 3, 200, 40),
        FastBlock("char_3gram_k10", lambda: F.slice(_grams(), 1, 5), lambda: F.slice(_grams(), 1, 4), 3, 100, 10),
        FastBlock("house_name", lambda: _housed(F.slice(_plain_tokens(), 1, 3)), lambda: _housed(F.slice(_plain_tokens(), 1, 3)), 2, 100, 30),
        FastBlock("combined_postal_name", lambda: _with_first("postal_code", "_", _plain_tokens()), lambda: _with_first("postal_code", "_", _plain_tokens()), 2, 100, 30),
        FastBlock("address_token", lambda: _address_words(F.slice(F.col("address_tokens"), 1, 2)), lambda: F.slice(_address_words(F.col("address_tokens")), 1, 2), 4, 150, 30),
        FastBlock("name_web_norm", _web_of_norm, lambda: _one(_web()), 4, 200, 40),
        FastBlock("house_token", lambda: _housed(F.slice(_plain_tokens(), 1, 3)), lambda: _housed(F.slice(_plain_tokens(), 1, 3)), 3, 150, 30),
    ]
}
_PLACE = ["source", "country", "block", "key"]
#: No list is longer, so of equal targets no more ids than this matter.
MOST = max(b.cap for b in RESEARCH.values())


def _stacked(df: DataFrame, blocks: dict[str, Column], *extra: Column) -> DataFrame:
    """One row for each key of each block: entity_id, source, country, block, pos, key."""

    def listed(name: str, keys: Column) -> Column:
        return F.transform(keys, lambda k, i: F.struct(F.lit(name).alias("block"), i.alias("pos"), k.alias("key")))

    lists = [listed(name, keys) for name, keys in blocks.items()]
    rows = df.where("country_norm <> ''").select("entity_id", F.substring("entity_id", 1, 2).alias("source"), F.col("country_norm").alias("country"), *extra, F.explode(F.concat(*lists)).alias("x"))
    return rows.select("*", "x.block", "x.pos", "x.key").drop("x")


def _limits(blocks) -> dict[str, Block]:
    return {b.filed: b for b in blocks}


def _of(values: dict[str, object], column: str = "block") -> Column:
    """A constant by block."""
    out = None
    for name, value in values.items():
        out = F.when(F.col(column) == name, F.lit(value)) if out is None else out.when(F.col(column) == name, F.lit(value))
    return out


#: Stands between the ids of a packed list.
_BETWEEN = "\u0001"


def _packed(ids: Column) -> Column:
    """A list to be sent: one string takes less than half of what an array of short strings does. A list that one string can't hold stays one."""
    odd = F.exists(ids, lambda i: i.contains(_BETWEEN)) | (F.size(ids) == 0)
    return F.struct(F.when(~odd, F.array_join(ids, _BETWEEN)).alias("text"), F.when(odd, ids).alias("list"))


def _unpacked(ids: Column) -> Column:
    return F.coalesce(ids["list"], F.split(ids["text"], _BETWEEN))


def _times(targets: DataFrame) -> Column:
    """How many ids a target's row stands for. Targets with equal rows may come as one of them, with n and ids (the first MOST)."""
    return F.col("n") if "n" in targets.columns else F.lit(1).cast("long")


def _capped(targets: DataFrame, blocks) -> tuple[DataFrame, DataFrame]:
    """entity_id, source, country, block (index), key after pruning and caps; and how often each key was filed (length) before.

    Too frequent keys are at most an entity's keys over the ratio, or fewer than half the rows of a pool too small for
    that, so they leave by a broadcast and the filed rows are not moved for it."""
    index = _limits(blocks)
    ids = [_packed(F.col("ids")).alias("ids")] if "ids" in targets.columns else []
    filed = _stacked(targets, {name: b.targets() for name, b in index.items()}, *ids).where(F.length("key") >= _of({n: b.least for n, b in index.items()})).drop("pos")
    # keys are counted for equal lists of keys at once
    of_length = lambda b: F.filter(b.targets(), lambda k: F.length(k) >= b.least)
    rows = targets.where("country_norm <> ''").select("entity_id", F.substring("entity_id", 1, 2).alias("source"), F.col("country_norm").alias("country"), _times(targets).alias("n"), F.explode(F.array(*[F.struct(F.lit(n).alias("block"), of_length(b).alias("keys")) for n, b in index.items()])).alias("x"))
    rows = rows.select("entity_id", "source", "country", "n", "x.*").where(F.size("keys") > 0)
    equal = rows.groupBy("source", "country", "block", "keys").agg(F.sum("n").alias("n"))
    lengths = equal.select("source", "country", "block", "n", F.explode("keys").alias("key")).groupBy(*_PLACE).agg(F.sum("n").alias("length"))
    pool = targets.groupBy(F.substring("entity_id", 1, 2).alias("source")).agg(F.sum(_times(targets)).alias("pool"))
    sizes = pool.select("source", "pool", F.explode(F.array(*map(F.lit, index))).alias("block"))  # one row for each source and block
    own = [n for n, b in index.items() if b.registered]
    if own:
        registered = rows.where(F.col("block").isin(own)).groupBy("source", "block", "entity_id").agg(F.max("n").alias("n")).groupBy("source", "block").agg(F.sum("n").alias("registered"))
        sizes = sizes.join(F.broadcast(registered), ["source", "block"], "left").withColumn("pool", F.when(F.col("block").isin(own), F.coalesce("registered", F.lit(0))).otherwise(F.col("pool")))
    sizes = sizes.select("source", "block", F.greatest(F.lit(1), F.floor(_of({n: b.ratio for n, b in index.items()}) * F.col("pool"))).alias("most"))
    over = lengths.join(F.broadcast(sizes), ["source", "block"]).where("length > most").select(*_PLACE)
    first = F.row_number().over(W.partitionBy(*_PLACE).orderBy("entity_id"))
    caps = {n: b.cap for n, b in index.items()}
    kept = filed.join(F.broadcast(over), _PLACE, "left_anti")
    if ids:  # equal targets are sent as lists, to where a key's lists are asked for
        kept = kept.repartition("country", "block", "key").select(*_PLACE, F.explode(_unpacked(F.col("ids"))).alias("entity_id"))
    # the largest cap as a number lets Spark limit the lists before they are sent
    kept = kept.withColumn("r", first).where((F.col("r") <= max(caps.values())) & (F.col("r") <= _of(caps)))
    return kept.select("entity_id", *_PLACE), lengths


def postings(targets: DataFrame, blocks) -> DataFrame:
    """entity_id, source, country, block (index), key, df (of the key in the source, all countries) after pruning and caps."""
    kept, lengths = _capped(targets, blocks)
    df = lengths.groupBy("source", "block", "key").agg(F.sum("length").alias("df"))
    return kept.join(df, ["source", "block", "key"]).select("entity_id", *_PLACE, "df")


def token_frequencies(targets: DataFrame) -> DataFrame:
    """source, key, df: how often a name token was filed, before pruning."""
    b = RESEARCH["name_token"]
    return _stacked(targets, {"name_token": b.targets()}, _times(targets).alias("n")).where(F.length("key") >= b.least).groupBy("source", "key").agg(F.sum("n").alias("df"))


def _tasks(df: DataFrame) -> int:
    """Exploded lists are many times the rows that are dealt out."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _families(blocks: list[Block]) -> dict[str, list[Block]]:
    """Blocks that count the shared keys of one index look up the same keys, so they are asked together and differ by limit."""
    out: dict[str, list[Block]] = {}
    for b in blocks:
        out.setdefault(b.filed if b.count else b.name, []).append(b)
    return out


#: Queries of a home at most.
_HOME = 128


def _hit_lists(queries: DataFrame, targets: DataFrame, names: list[str], by_marks: bool = False) -> tuple[DataFrame, DataFrame]:
    """source1_entity_id, block (family), profile, at; and at, block, profile, source, hits: place (1 is best), marks (bit i: of names[i])
    and candidate_entity_id. by_marks: marks beside the list, and candidate ids alone in it, packed.

    Queries that ask a family for the same keys get the same list: it is made once, for the least of them. at is where it lies."""
    families = _families([RESEARCH[n] for n in names])
    limit = lambda b: (b.limit() if callable(b.limit) else F.lit(b.limit)).cast("int")
    asks = [F.struct(F.lit(f).alias("block"), bs[0].queries().alias("keys"), F.array(*[limit(b) for b in bs]).alias("most")) for f, bs in families.items()]
    asked = queries.where("country_norm <> ''").select(F.col("entity_id").alias("source1_entity_id"), F.col("country_norm").alias("country"), F.explode(F.array(*asks)).alias("x"))
    asked = asked.where(F.size("x.keys") > 0).groupBy("source1_entity_id", "x.block").agg(F.array_sort(F.collect_list(F.struct("country", "x.keys", "x.most"))).alias("asks"))
    # with by_marks, profiles that count the keys of whole lists meet these in groups that begin with the same key
    counted = [f for f, (b, *_) in families.items() if b.count]
    start = F.xxhash64("asks") if not by_marks else F.when(F.col("block").isin(counted), F.xxhash64(F.col("asks")[0]["country"], F.col("asks")[0]["keys"][0])).otherwise(F.xxhash64("asks"))
    asked = asked.withColumn("start", start).repartition("block", "start")
    asked = asked.withColumn("profile", F.min("source1_entity_id").over(W.partitionBy("block", "start", "asks")))
    group = F.floor((F.dense_rank().over(W.partitionBy("block", "start").orderBy("asks")) - 1) / _HOME)
    asked = asked.withColumn("at", F.xxhash64("block", "start", group)).drop("start").persist()
    members = asked.select("source1_entity_id", "block", "profile", "at")
    asked = asked.where("source1_entity_id = profile").select("at", "profile", "block", F.explode("asks").alias("a")).select("at", "profile", "block", "a.country", "a.most", F.posexplode("a.keys").alias("pos", "key"))
    rare = {n: b.rare for n, (b, *_) in families.items() if b.rare}
    if rare:
        sources = targets.select(F.substring("entity_id", 1, 2).alias("source")).distinct()
        per = asked.where(F.col("block").isin(list(rare))).crossJoin(F.broadcast(sources))  # a handful of sources, by their prefix
        per = per.join(token_frequencies(targets), ["source", "key"], "left").withColumn("df", F.coalesce("df", F.lit(999_999)))
        order = W.partitionBy("profile", "source", "block").orderBy("df", "pos")
        per = per.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= _of(rare)).drop("df")
        asked = asked.where(~F.col("block").isin(list(rare))).withColumn("source", F.lit(None).cast("string")).unionByName(per)
    else:
        asked = asked.withColumn("source", F.lit(None).cast("string"))
    asked = asked.withColumn("index", _of({f: b.filed for f, (b, *_) in families.items()})).withColumnRenamed("source", "only")
    # a list holds at most its block's cap, so lists travel whole; pairs appear only where a profile's lists have met
    filed, _ = _capped(targets, [b for bs in families.values() for b in bs])
    lists = filed.groupBy("source", "country", F.col("block").alias("index"), "key").agg(F.array_sort(F.collect_list("entity_id")).alias("ids"))
    limited = F.element_at("most", 1).isNotNull() & ~F.col("block").isin(counted)
    ask = F.struct("block", "country", "key", F.coalesce("only", F.lit("")).alias("only"))
    wanted = asked.select("at", "block", "country", "index", "key", "only", F.when(limited, F.element_at("most", 1)).alias("take")).distinct()
    # the first candidates of a profile are among the first of each of its lists
    enough = F.when(F.col("take").isNull(), F.col("ids")).otherwise(F.slice("ids", F.lit(1), F.coalesce("take", F.lit(1))))
    sent = wanted.join(lists, ["country", "index", "key"]).where("only is null or only = source")
    sent = sent.select(F.col("at").alias("to"), ask.alias("ask"), "source", _packed(enough).alias("ids")).repartition(_tasks(targets), "to").withColumn("ids", _unpacked(F.col("ids")))
    width = range(max(map(len, families.values())))
    own = asked.select("at", "profile", "block", "pos", F.array(ask).alias("asks"), *[F.get("most", F.lit(i)).alias(f"most{i}") for i in width]).repartition(_tasks(targets), "at")
    met = own.join(sent, (F.col("at") == F.col("to")) & F.array_contains("asks", F.col("ask")))
    pair = met.select("at", "profile", "source", "block", "pos", *[f"most{i}" for i in width], F.explode("ids").alias("candidate_entity_id"))
    pair = pair.groupBy("at", "profile", "block", "source", "candidate_entity_id").agg(F.min("pos").alias("pos"), F.count("*").alias("shared"), *[F.max(f"most{i}").alias(f"most{i}") for i in width])
    rank = F.when(F.col("block").isin(counted), -F.col("shared")).otherwise(F.col("pos"))
    place = F.row_number().over(W.partitionBy("at", "profile", "block", "source").orderBy(rank, "candidate_entity_id"))
    marks = None
    for f, bs in families.items():
        within = sum((F.when(F.col(f"most{i}").isNull() | (F.col("place") <= F.col(f"most{i}")), 1 << names.index(b.name)).otherwise(0).cast("long") for i, b in enumerate(bs)), F.lit(0).cast("long"))
        marks = F.when(F.col("block") == f, within) if marks is None else marks.when(F.col("block") == f, within)
    best = pair.withColumn("place", place).withColumn("marks", marks).where("marks <> 0")
    if by_marks:
        hits = best.groupBy("at", "profile", "block", "source", "marks").agg(_packed(F.array_sort(F.collect_list("candidate_entity_id"))).alias("hits"))
    else:
        hits = best.groupBy("at", "profile", "block", "source").agg(F.array_sort(F.collect_list(F.struct("place", "marks", "candidate_entity_id"))).alias("hits"))
    return members, hits


def marked(names: list[str], marks: Column) -> Column:
    """The names whose bits are set, in their order in names."""
    return F.array_compact(F.array(*[F.when(marks.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(n)) for i, n in enumerate(names)]))


def _with_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Joins by block and profile where the lists lie."""
    own = rows.select([c for c in rows.columns if c not in ("block", "profile", "at")] + [F.col("at").alias("to"), F.array(F.struct("block", "profile")).alias("own")])
    return own.join(lists, (F.col("to") == F.col("at")) & F.array_contains("own", F.struct("block", "profile"))).drop("to", "own", "at")


def research_hits(queries: DataFrame, targets: DataFrame, names: list[str]) -> DataFrame:
    """source1_entity_id, candidate_entity_id, source, block, place (1 is best) of the named blocks."""
    members, lists = _hit_lists(queries, targets, names)
    rows = _with_lists(members, lists).select("source1_entity_id", "source", F.explode("hits").alias("x"))
    block = F.lit(names[0]).alias("block") if len(names) == 1 else F.explode(marked(names, F.col("x.marks"))).alias("block")
    return rows.select("source1_entity_id", "x.candidate_entity_id", "source", block, "x.place")


def marked_pairs(queries: DataFrame, targets: DataFrame, names: list[str], truth: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """One row for each pair of the named blocks or of truth: home, source1_entity_id, source, candidate_entity_id, marks (bit i:
    found by names[i]; bit len(names): true); and the home of each query. truth: source1_entity_id, profile; and profile, source, hits.

    Queries that share their longest list, and most others with it, have one home, and a list is sent to it once. Lists without a
    limit are the longest, of those the ones of blocks named later, which ask for less of a record. A home's rows stay together. Homes that clash by hash only share a place, as a query takes the lists that it asks."""
    members, lists = _hit_lists(queries, targets, names, by_marks=True)
    if truth is not None:
        members = members.unionByName(truth[0].select("source1_entity_id", "profile", F.lit("").alias("block"), F.lit(None).cast("long").alias("at")))
    families = list(_families([RESEARCH[n] for n in names]).items())
    order = [f for f, (b, *_) in families[::-1] if b.limit is None] + [f for f, (b, *_) in families if b.limit is not None]
    order = F.coalesce(_of({f: i for i, f in enumerate(order)}), F.lit(len(names)))
    asked = members.groupBy("source1_entity_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("n"), "block", "profile", "at"))).alias("asks"))
    asked = asked.withColumn("first", F.element_at("asks", 1))
    place = F.row_number().over(W.partitionBy("first").orderBy("asks", "source1_entity_id")) - 1
    homes = asked.withColumn("home", F.xxhash64("first.block", "first.profile", F.floor(place / _HOME))).persist()
    wanted = homes.select("home", F.explode("asks").alias("x")).select("home", "x.block", "x.profile", "x.at").distinct()
    columns = ["home", "block", "profile", "source", "marks", "hits"]
    sent = _with_lists(wanted, lists).select(columns)
    if truth is not None:  # apart, as the lists of blocks lie where they are joined
        true = truth[1].select(F.lit("").alias("block"), "profile", "source", F.lit(1 << len(names)).cast("long").alias("marks"), _packed(F.col("hits")).alias("hits"))
        sent = sent.unionByName(wanted.join(true, ["block", "profile"]).select(columns))
    sent = sent.select("home", F.struct("block", "profile").alias("ask"), "source", "marks", "hits").repartition(_tasks(targets), "home").withColumn("hits", _unpacked(F.col("hits")))
    asks = F.transform("asks", lambda a: F.struct(a["block"].alias("block"), a["profile"].alias("profile")))
    own = homes.select(F.col("home").alias("at"), "source1_entity_id", asks.alias("asks")).repartition(_tasks(targets), "at")
    met = own.join(sent, (F.col("at") == F.col("home")) & F.array_contains("asks", F.col("ask")))
    met = met.select("home", "source1_entity_id", "source", "marks", F.explode("hits").alias("candidate_entity_id"))
    return met.groupBy("home", "source1_entity_id", "source", "candidate_entity_id").agg(F.bit_or("marks").alias("marks")), homes.select("source1_entity_id", "home")


def fast_hits(queries: DataFrame, targets: DataFrame, names: list[str] | None = None) -> DataFrame:
    """source1_entity_id, candidate_entity_id, source, block of the fast blocks. Countries are compared as normalised."""
    blocks = [FAST[n] for n in (names or FAST)]
    least, cap, limit = ({b.name: getattr(b, k) for b in blocks} for k in ("least", "cap", "limit"))
    filed = _stacked(targets, {b.name: b.targets() for b in blocks}).where(F.length("key") >= _of(least))
    filed = filed.withColumn("r", F.row_number().over(W.partitionBy(*_PLACE).orderBy("entity_id", "pos"))).where(F.col("r") <= _of(cap))
    lists = filed.groupBy(*_PLACE).agg(F.array_sort(F.collect_list(F.struct("r", "entity_id"))).alias("ids"))
    asked = _stacked(queries, {b.name: b.queries() for b in blocks}).withColumnRenamed("entity_id", "source1_entity_id").drop("source")
    # no more than the limit of any one list can count
    met = asked.join(lists, ["country", "block", "key"]).select("source1_entity_id", "source", "block", "pos", F.slice("ids", F.lit(1), _of(limit)).alias("ids")).repartition("source1_entity_id")
    found = met.select("source1_entity_id", "source", "block", "pos", F.explode("ids").alias("x")).select("*", "x.r", F.col("x.entity_id").alias("candidate_entity_id"))
    place = F.row_number().over(W.partitionBy("source1_entity_id", "source", "block").orderBy("pos", "r"))
    return found.withColumn("place", place).where(F.col("place") <= _of(limit)).select("source1_entity_id", "candidate_entity_id", "source", "block").distinct()
