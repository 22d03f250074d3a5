"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set is its distinct k-word shingles (hashed to 64 bits). HASHES independent minimum hashes are its signature;
the first COORDINATES of them, each on its own, are the coordinates. Documents with equal sets are one class and only the
class's representative (smallest id, then hash of the text) is posted, once under each coordinate-value pair, by its place
in the order of representatives; rows that share an id, or have none, are thus told apart by their texts:

    postings(coordinate-value, representative)

Lists of one member end there. The others are merged without writing out their pairs:

* prefix: a pair must collide in COMMON coordinates or more, so it meets in one of the COORDINATES - COMMON + 1 rarest
  coordinate-value pairs of both; the COMMON - 1 most frequent ones of each document are not merged. Values that passages
  common to many documents bring leave here, and so do documents that share fewer than COMMON values with any other.
* pivot rounds: each list proposes only (member, pivot). A proposed pair counts its collisions over all HASHES, is
  retained from MATCHES up, and is then confirmed on the full sets. Confirmed links are joined to components.
* skipping: a list whose members already share a component needs no further work. Lists that span components get a
  new pivot in the next round.
* before sets are compared, parity sketches give a bound on the symmetric difference that rejects almost all other pairs.
* the rest is exact: in lists that still span components after ROUNDS rounds, every pair across components is counted, in
  blocks of bounded size spread over the cluster.

So no cap stands on lists, partners or candidates. The one thing that can lose a link is the signature itself: two texts
of similarity 0.8 collide in fewer than 13 of 32 coordinates with probability 2e-7, and in fewer than MATCHES of all hashes
with a smaller one. Representatives, links and components stay distributed throughout.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common
from .exact_dedup import run_count

HASHES, COORDINATES, COMMON = 128, 32, 13
#: Of 128 hashes, 102.4 collide on average at similarity 0.8 with a standard deviation of 4.5.
MATCHES = 72
ROUNDS = 3
#: Members on either side of a block of the exact remainder.
BLOCK = 256
#: Bits of a parity sketch: four times the set's size, within these powers of two.
LEAST_BITS, MOST_BITS = 2048, 32768
#: Rows of short lists in a group of the exact remainder, and pairs compared at a time.
GROUP, PAIRS = 2000, 20_000
#: Links in a file between two steps of the components.
EDGES = 50_000
#: Ids of candidate documents are broadcast up to this many, 24 bytes each; beyond, they are joined by a shuffle.
BROADCAST_IDS = 400_000

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_MULT = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_ORDER = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _ORDER * np.arange(1, 65, dtype=np.uint64)
_COORDINATE = np.arange(1, COORDINATES + 1, dtype=np.uint64) * _STEP
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_STEP, _UNSTEP)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash for each word [^\\x20\\x09-\\x0D]+ of the text, A-Z lower-cased."""
    a = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(a):
        return np.empty(0, np.uint64)
    edge = np.diff(np.concatenate(([True], _SPACE[a], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power_tables(len(a) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * up[: len(a)])))
    return _mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, of the whole sequence."""
    w = word_hashes(text or "")
    n = min(k, len(w))
    if not n:
        return w
    out = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        out += _mixed(w[i : len(w) - n + 1 + i] + _SHIFT[i % 64]) * _ORDER[(i + 7) % 64]
    return np.unique(_mixed(out + np.uint64(n)))


def signature(s: np.ndarray) -> np.ndarray:
    """The HASHES minimum hashes of a set."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(out, (s[None, i : i + 1024] * _MULT[:, None]).min(1), out=out)
    return out


def parity_sketch(s: np.ndarray) -> bytes:
    """A bit for each residue of the hashes by the sketch's length, set if an odd number of members has it.

    The exclusive or of two sketches is the sketch of the sets' symmetric difference and has at most as many bits as that
    has members: a bound that never rejects a link. Halves of a sketch folded onto each other give the shorter sketch.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(4 * len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _differences(x: list[bytes], p: np.ndarray, y: list[bytes], q: np.ndarray) -> np.ndarray:
    """Least possible size of the symmetric difference of x[p] and y[q], by their parity sketches."""
    size_x, size_y = np.array([len(b) for b in x]), np.array([len(b) for b in y])
    short = np.minimum(size_x[p], size_y[q])
    out = np.empty(len(p), np.int64)

    def folded(sketches, used, width):
        rows = np.zeros((len(sketches), width // 8), np.uint64)
        for i in np.unique(used):
            rows[i] = np.bitwise_xor.reduce(np.frombuffer(sketches[i], np.uint64).reshape(-1, width // 8), axis=0)
        return rows

    for width in np.unique(short):
        at = np.flatnonzero(short == width)
        a, b = folded(x, p[at], width), folded(y, q[at], width)
        for i in range(0, len(at), PAIRS):
            part = at[i : i + PAIRS]
            out[part] = np.bitwise_count(a[p[part]] ^ b[q[part]]).sum(1)
    return out


def _sketched(k: int):
    def run(batches):
        for pdf in batches:
            rows = []
            for i, h, text in zip(pdf["doc_id"], pdf["h"], pdf["text"]):
                s = shingle_set(text, k)
                if not len(s):
                    rows.append((i, h, 0, None, None, None))
                    continue
                sig = signature(s)
                values = _mixed(sig[:COORDINATES] ^ _COORDINATE)
                short = (sig & np.uint64(0xFFFF)).astype(np.uint16).tobytes()
                rows.append((i, h, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), short, values.astype(np.int64).tolist()))
            yield pd.DataFrame(rows, columns=["doc_id", "h", "n_shingles", "cls", "sig", "values"])

    return run


def _sets(k: int):
    def run(batches):
        for pdf in batches:
            sets = [shingle_set(t, k) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "s": [s.tobytes() for s in sets], "parity": [parity_sketch(s) for s in sets]})

    return run


def _collided(percent: int):
    """Keeps pairs whose signatures agree in MATCHES hashes or more and whose sketches allow the similarity."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                a = np.frombuffer(b"".join(pdf["sig_a"]), np.uint16).reshape(-1, HASHES)
                b = np.frombuffer(b"".join(pdf["sig_b"]), np.uint16).reshape(-1, HASHES)
                row = np.arange(len(pdf))
                apart = _differences(list(pdf["parity_a"]), row, list(pdf["parity_b"]), row)
                both = (pdf["n_a"] + pdf["n_b"]).to_numpy()
                yield pdf.loc[((a == b).sum(1) >= MATCHES) & (apart * (100 + percent) <= both * (100 - percent)), ["a", "b"]]

    return run


def _confirmed(percent: int):
    def run(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["s_a"], pdf["s_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return run


def _block_pairs(percent: int):
    """Of the lists in one block: pairs across components that reach MATCHES, each in the list of its least common value."""

    def padded(posted, filler):
        out = np.full((len(posted), max(map(len, posted))), filler, np.int64)
        for i, values in enumerate(posted):
            out[i, : len(values)] = values
        return out


    def run(left, right):
        found = [np.empty((0, 2), np.int64)]
        if len(left) and len(right):
            x = np.frombuffer(b"".join(left["sig"]), np.uint16).reshape(len(left), HASHES)
            y = np.frombuffer(b"".join(right["o_sig"]), np.uint16).reshape(len(right), HASHES)
            most = np.iinfo(np.int64).max
            mine, theirs = padded(left["posted"], most), padded(right["o_posted"], np.iinfo(np.int64).min)
            a = {c: left[c].to_numpy() for c in ("value", "rep", "comp", "n")}
            b = {c: right[f"o_{c}"].to_numpy() for c in ("value", "rep", "comp", "n", "outer")}
            order = np.argsort(b["value"], kind="stable")
            ranked = b["value"][order]
            lo, hi = (np.searchsorted(ranked, a["value"], side=e) for e in ("left", "right"))
            ends = np.cumsum(hi - lo)
            i = 0
            while i < len(left):  # as many members at a time as make about PAIRS pairs
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, side="right")))
                count = (hi - lo)[i:j]
                p = np.repeat(np.arange(i, j), count)
                q = order[np.arange(count.sum()) + np.repeat(lo[i:j] - np.cumsum(count) + count, count)]
                small, large = np.minimum(a["n"][p], b["n"][q]), np.maximum(a["n"][p], b["n"][q])
                # two outer members meet twice, once on either side: the smaller id speaks
                may = (a["comp"][p] != b["comp"][q]) & (~b["outer"][q] | (b["rep"][q] > a["rep"][p])) & (100 * small >= percent * large)
                p, q = p[may], q[may]
                apart = _differences(left["parity"].tolist(), p, right["o_parity"].tolist(), q)
                may = apart * (100 + percent) <= (a["n"][p] + b["n"][q]) * (100 - percent)
                p, q = p[may], q[may]
                keep = (x[p] == y[q]).sum(1) >= MATCHES
                p, q = p[keep], q[keep]
                both = (mine[p][:, :, None] == theirs[q][:, None, :]).any(2)
                keep = np.where(both, mine[p], most).min(1, initial=most) == a["value"][p]
                u, v = a["rep"][p[keep]], b["rep"][q[keep]]
                found.append(np.stack((np.minimum(u, v), np.maximum(u, v)), 1))
                i = j
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def components(edges: DataFrame) -> DataFrame:
    """id, comp (smallest id reachable) of every id in edges (u, v), by alternating large-star and small-star steps.

    Each step lets all neighbours of an id point at its smallest; both ways of grouping pre-aggregate, and nothing but
    two numbers reaches the driver. The steps end when every id points at one that points nowhere.
    """
    now = common.stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    files = max(1, now.count() // EDGES)
    while True:
        # what is grouped by an id is written before it is joined by that id, so that adaptive execution can split the links
        # of a large star's centre
        both = now.union(now.select("v", "u"))
        low = common.stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")).coalesce(files), "low")
        large = common.stored(both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = common.stored(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m").coalesce(files), "least")
        small = large.join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = common.stored(small.union(least.select("k", "m")).distinct().coalesce(files), "links")
        common.dropped(low, large, least)
        common.dropped(now)
        now = after
        ends = now.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(now.select("v", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)")
        if not open_.coalesce(files).agg(F.count("*")).first()[0]:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def _with_comp(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.join(comps, members["rep"] == comps["id"], "left").select(*members.columns, F.coalesce("comp", "rep").alias("comp"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Two documents are linked if 100 * intersection >= percent * union of their sets of k-word shingles. component_id is
    the smallest doc_id reachable over links, kept = (doc_id = component_id). Null, empty and wordless texts have no
    shingles, are linked with nothing and stay. Equal sets are always linked. Rows are told apart by id and text: rows that
    repeat an id, or have a null one, are each in the component of their own text (a null id is the last of all, and
    reported as null). Texts are read whole, however long. Extra columns are ignored, also those named like inner ones; an
    empty table gives an empty result.
    percent below 80 lowers the signature's recall; the constants above are set for 80 and more.
    """
    spark = docs.sparkSession
    common.python_ready(spark)
    runs = run_count(spark)
    plain = docs.select(common.id_in(id_col).alias("doc_id"), F.xxhash64(common.whole_text(text_col)).alias("h"), F.col(text_col).alias("text"))
    base = common.stored(
        plain.mapInPandas(_sketched(k), "doc_id long, h long, n_shingles long, cls binary, sig binary, values array<long>").withColumn(
            "run", F.pmod(F.xxhash64("doc_id", "h"), F.lit(runs)).cast("int")
        ),
        "sketches",
    )
    worded = base.where("cls is not null")
    entries = worded.groupBy("cls", "run").agg(F.min(F.struct("doc_id", "h")).alias("best"))
    classes = common.stored(entries.groupBy("cls").agg(F.min("best").alias("best")).select("cls", "best.doc_id", "best.h"), "classes")
    # partitions follow one another in the order of ids, and so do the numbers
    order = ["doc_id", "h", "cls"]
    classes = common.stored(
        classes.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order).withColumn("rep", F.monotonically_increasing_id()), "numbers"
    )
    reps = common.stored(
        worded.select(*order, F.col("n_shingles").alias("n"), "sig", "values").join(classes, order).dropDuplicates(["rep"]).select("rep", "n", "sig", "values"),
        "representatives",
    )
    links = _links(spark, plain, classes, reps, k, percent)
    common.dropped(reps)
    if links is None:
        comp_of = classes.select("cls", F.col("doc_id").alias("component_id"))
    else:
        ends = classes.select(F.col("rep").alias("comp"), F.col("doc_id").alias("component_id"))
        comp_of = _with_comp(classes.select("cls", "rep"), components(links)).join(ends, "comp").select("cls", "component_id")
    of_run = entries.select("cls", "run").join(comp_of, "cls")
    return (
        base.select("doc_id", "n_shingles", "cls", "run")
        .join(of_run, ["cls", "run"], "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .select(common.id_out("doc_id"), "n_shingles", common.id_out("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))
    )


def _links(spark, plain: DataFrame, classes: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Confirmed links (u, v) between representatives that give the same components as all links; None without any list."""
    posts = reps.select("rep", F.explode("values").alias("value"))
    # what is grouped by value is written before it is joined: both sides of such a join are then dealt out for it alone,
    # and adaptive execution can split the partition of a long list
    sizes = common.stored(posts.groupBy("value").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    frequent = W.partitionBy("rep").orderBy(F.desc("size"), F.desc("value"))
    prefix = posts.join(sizes, "value").withColumn("place", F.row_number().over(frequent)).where(F.col("place") >= COMMON)
    prefix = common.stored(prefix.select("rep", "value"), "prefixes")
    heads = common.stored(prefix.groupBy("value").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).where("size > 1"), "heads")
    lists = common.stored(prefix.join(heads, "value"), "lists")
    ids = common.stored(lists.select("rep").distinct(), "candidates")
    n = ids.count()
    if not n:
        return None
    wanted = classes.join(ids, "rep").select("doc_id", "h", F.col("rep").alias("id"))
    texts = plain.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, ["doc_id", "h"]).select("id", "text")
    sets = common.stored(texts.mapInPandas(_sets(k), "id long, s binary, parity binary").dropDuplicates(["id"]), "sets")
    sigs = common.stored(reps.join(sets.select(F.col("id").alias("rep"), "parity"), "rep").select("rep", "n", "sig", "parity"), "signatures")

    def checked(pairs: DataFrame) -> DataFrame:
        a, b = (sigs.select(F.col("rep").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "sig", "parity")]) for c in "ab")
        near = pairs.join(a, "a").join(b, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        return confirmed(near.mapInPandas(_collided(percent), "a long, b long"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("id").alias(c), F.col("s").alias(f"s_{c}")) for c in "ab")
        full = pairs.join(a, "a").join(b, "b").select("a", "b", "s_a", "s_b")
        return full.mapInPandas(_confirmed(percent), "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v"))

    links = common.stored(checked(lists.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()), "links")
    scratch = [sizes, prefix, heads, lists, ids, sets, sigs, links]
    more = None
    for step in range(ROUNDS):
        found = common.stored(components(links), "components")
        links = found.where("id <> comp").select(F.col("id").alias("u"), F.col("comp").alias("v"))
        spread = _spread(lists, found)
        scratch += [found, spread]
        if spread.isEmpty():
            break
        if step + 1 == ROUNDS:
            more = confirmed(_remainder(spread, sigs, percent).distinct())
            break
        # the next pivot is some member outside the first pivot's component, another one in each list
        nxt = common.stored(spread.where("comp <> pivot_comp").groupBy("value").agg(F.min(F.struct(F.xxhash64("value", "rep").alias("h"), "rep", "comp")).alias("p")), "pivots")
        pairs = spread.join(nxt, "value").where("comp <> p.comp").select(F.least("p.rep", "rep").alias("a"), F.greatest("p.rep", "rep").alias("b")).distinct()
        links = common.stored(links.union(checked(pairs)), "links")
        scratch += [nxt, links]
    out = common.stored(links if more is None else links.union(more), "links")
    common.dropped(*scratch)
    return out


def _spread(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of the lists that span components, with their components and the pivot's."""
    members = _with_comp(lists, comps)
    state = members.groupBy("value").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.when(F.col("rep") == F.col("pivot"), F.col("comp"))).alias("pivot_comp")
    )
    state = common.stored(state.where("lo <> hi").select("value", "pivot_comp"), "state")
    out = common.stored(members.join(state, "value"), "spread")
    common.dropped(state)
    return out


def _remainder(spread: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """All pairs across components in lists that span several, except those within a list's largest component.

    Outer members (not of the largest component) meet every member. Both sides of a list longer than BLOCK are cut into
    blocks by a hash of the id, so a list of any length becomes many tasks of at most about BLOCK x BLOCK comparisons;
    shorter lists are dealt whole, some thousand rows of them to a task's group.
    """
    groups = max(1, spread.count() // GROUP)
    most = spread.groupBy("value", "comp").agg(F.count("*").alias("c")).groupBy("value").agg(
        F.max(F.struct("c", "comp"))["comp"].alias("main"), F.ceil(F.sum("c") / BLOCK).cast("int").alias("blocks")
    )
    # members of different components share no list but those that span components
    posted = common.stored(spread.groupBy("rep").agg(F.collect_set("value").alias("posted")), "posted")
    members = spread.join(common.stored(most, "most"), "value").join(sigs, "rep").join(posted, "rep").select(
        "value", "rep", "comp", "n", "sig", "parity", "posted", "blocks", (F.col("comp") != F.col("main")).alias("outer"),
        (F.col("blocks") > 1).alias("cut"), F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("own"),
        F.when(F.col("blocks") > 1, F.col("value")).otherwise(F.pmod(F.xxhash64("value"), F.lit(groups))).alias("group"),
    )
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = members.where("outer").withColumn("y", others).withColumn("x", F.col("own"))
    right = members.withColumn("x", others).withColumn("y", F.col("own"))
    key, cols = ["cut", "group", "x", "y"], ["value", "rep", "comp", "n", "sig", "parity", "posted", "outer"]
    right = right.select([F.col(c).alias(f"o_{c}") for c in key + cols])
    return (
        left.select([F.col(c).alias(c) for c in key + cols]).groupBy(key)
        .cogroup(right.groupBy([f"o_{c}" for c in key]))
        .applyInPandas(_block_pairs(percent), "a long, b long")
    )


def without_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of near_duplicates(), all columns as they were: that of the smallest id.

    Rows are told apart by id and text, so a repeated or null id stands for each of its texts; of equal rows that have
    words one stays.
    """
    key = common.row_key(id_col, text_col)
    ids = common.stored(docs.select(key.alias("key"), common.id_in(id_col).alias("id")), "keys")
    found = near_duplicates(docs.select(key.alias("key"), F.col(text_col).alias("text")), k, percent, "key")
    found = common.stored(found.select(common.id_in("doc_id").alias("key"), "n_shingles", common.id_in("component_id").alias("comp")).distinct().join(ids.distinct(), "key"), "found")
    stay = found.groupBy("comp").agg(F.min(F.struct("id", "key"))["key"].alias("key"))
    out = found.join(stay, "key", "left_anti").select(F.col("key").alias("__out"))
    once = common.repeated_keys(ids).join(found.where("n_shingles > 0").select(F.col("key").alias("__once")), "__once", "left_semi")
    return common.without(docs, out, key, once)


def op9_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(common.documents(spark, sf_dir), k=4, percent=80)


def oracle(k: int, percent: int) -> str:
    """Links by counting common shingles of all pairs, components by following links: for small tables."""
    upper = "".join(map(chr, range(65, 91)))
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))) END AS sh FROM w
), p AS (SELECT doc_id, unnest(sh) AS x, len(sh) AS n FROM s
), link AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM p a JOIN p b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT r.id, l.v FROM reach r JOIN link l ON l.u = r.seen
), c AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.id = s.doc_id
"""


ORACLE = oracle(4, 80)
