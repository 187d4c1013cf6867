"""MinHash near-duplicates: banded minima, links confirmed on full sets, components by alternating stars.

A document's set has its distinct shingles of ``shingle`` words (A-Z lower-cased) as 64-bit hashes.

1. Equal sets (by a 128-bit hash of the sorted set) are one: the smallest doc_id stands for them.
2. ``bands`` * ``rows`` minima of universal hashes give each representative a key for every band. Two sets
   with Jaccard similarity s share a key with probability 1 - (1 - s**rows)**bands: at 0.8 and 8 rows in
   56 bands all but 3.4 in 100,000 links, at 0.85 all but 2 in 100,000,000; at 0.3 four in 1,000 pairs.
3. In a bucket of equal keys each member is paired with the smallest only, never with all others. Pairs
   whose sizes rule a link out, or whose SIGNATURE minima agree in fewer than AGREE places (a link does so once in
   10**8 or less), are dropped; the others are confirmed on the full sets, and linked documents form components.
4. Buckets that still hold several components may hide a link between two members of which neither is the
   smallest. Such links across components are found exactly, by the first shingle that two sets share when shingles
   are ordered from rare to common (by the number of these members that have them). It lies within both sets'
   prefixes: all but the last 80 % of the set, and one more. If RARE members or fewer have it, the two meet in its
   list, which is as short. Otherwise they share no rare shingle at all: of sets of n and m shingles, e and f of them
   common, a link needs (100 + p) e >= p (n + m), p the threshold in percent, and likewise f. Members of a bucket that
   fulfil both meet. (Strays of a large group, full of shingles that few others have, do so with hardly any.) All that
   meet are checked as in 3 and joined to the components.

No pair that shares a band is given up and no bucket is capped. The dearest part of 4 compares four numbers for each
member outside its bucket's first component and each member of the bucket. Joins by a document that stands in many
pairs, such as the smallest of a large group, deal its rows over several tasks (``spread_join``). What shares no band is
found by ``exact`` alone.

Defined cases: null, empty or wordless texts have an empty set, n_shingles 0, and are linked with nothing;
fewer words than ``shingle`` are one shingle; rows with the same doc_id are one document with several sets;
rows with null doc_id are linked with nothing, have a null component_id and are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HashCache, mix64, per_text, private, remove, spread_join, steps, stored, texts_of, window_hashes, word_hashes
from .components import components

SHINGLE = 5
PERCENT = 80
ROWS = 8
BANDS = 56
#: Bytes of a set's short signature (one from each of so many minima), and in how many a link agrees at least.
SIGNATURE = 64
AGREE = 32
#: Members that may have a rare shingle at most.
RARE = 128
SEED = 11
#: Ids of this many documents are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Set elements hashed at once.
_BLOCK = 1024


def shingles(text: bytes, n: int, cache: HashCache) -> np.ndarray:
    """Sorted distinct hashes."""
    words = text.lower().split()
    return np.unique(window_hashes(word_hashes(words, cache), min(n, len(words)))) if words else np.empty(0, np.uint64)


class Minima:
    """Band keys of sets: minima of strongly universal hashes a * x + b (64-bit, x of 32 bits, ordered by the high bits)."""

    def __init__(self, rows: int = ROWS, bands: int = BANDS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        k = rows * bands
        self.rows, self.bands = rows, bands
        self.a, self.b = (rng.integers(0, 1 << 64, k, dtype=np.uint64) for _ in range(2))
        self.a |= np.uint64(1)
        self.buffer = np.empty((_BLOCK, k), np.uint64)

    def signature(self, s: np.ndarray) -> np.ndarray:
        x, low = s >> np.uint64(32), None
        for i in range(0, len(x), _BLOCK):
            part = x[i : i + _BLOCK, None]
            out = self.buffer[: len(part)]
            np.multiply(part, self.a, out=out)
            np.add(out, self.b, out=out)
            m = out.min(0)
            low = m if low is None else np.minimum(low, m)
        return low >> np.uint64(32)

    def keys(self, sig: np.ndarray) -> np.ndarray:
        sig = sig.reshape(self.bands, self.rows)
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for r in range(self.rows):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + sig[:, r])
        return out.view(np.int64)


def signed(docs: DataFrame, id_col: str, text_col: str, shingle: int, rows: int, bands: int, seed: int) -> DataFrame:
    """id, n (set size), lo, hi (hash of the set), keys, short (the first minima, a byte each, for signature checks)."""

    def make():
        cache, minima = HashCache(), Minima(rows, bands, seed)

        def work(texts: list[bytes]) -> list:
            n, lo, hi, keys, short, seen = [], [], [], [], [], {}
            for t in texts:
                got = seen.get(t)
                if got is None:
                    s = shingles(t, shingle, cache)
                    if len(s):
                        h = xxhash.xxh3_128_digest(s.tobytes())
                        sig = minima.signature(s)
                        got = (len(s), int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), minima.keys(sig), sig[:SIGNATURE].astype(np.uint8).tobytes())
                    else:
                        got = (0, None, None, None, None)
                    seen[t] = got
                for column, value in zip((n, lo, hi, keys, short), got, strict=True):
                    column.append(value)
            return [n, lo, hi, keys, short]

        return work

    long = (T.LongType(), pa.int64())
    fields = [("n", *long), ("lo", *long), ("hi", *long), ("keys", T.ArrayType(T.LongType()), pa.list_(pa.int64())), ("short", T.BinaryType(), pa.binary())]
    return per_text(docs, [id_col], text_col, fields, make).withColumnRenamed(id_col, "id")


def sets_of(docs: DataFrame, ids: DataFrame, n_ids: int, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, set) of the documents in ``ids``, from their texts."""
    wanted = F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(wanted, "id", "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in steps(texts):
                values = [shingles(t, shingle, cache).view(np.int64) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(values, pa.list_(pa.int64()))], names=["id", "set"])

    return picked.mapInArrow(run, T.StructType([picked.schema["id"], T.StructField("set", T.ArrayType(T.LongType(), False))]))


def plausible(pairs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sizes allow a link and whose short signatures agree often enough."""
    facts = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("short").alias(f"short_{c}"))
    both = spread_join(pairs, facts("a"), "a", "b").join(facts("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    x, y = F.hex("short_a"), F.hex("short_b")
    agree = F.aggregate(F.sequence(F.lit(1), F.length(x), F.lit(2)), F.lit(0), lambda acc, i: acc + (F.substring(x, i, F.lit(2)) == F.substring(y, i, F.lit(2))).cast("int"))
    return both.where(agree >= AGREE).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    both = spread_join(pairs, left, "a", "b").join(right, "b").withColumn("i", shared)
    return both.where((100 + percent) * F.col("i") >= percent * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def across(buckets: DataFrame, sets: DataFrame, percent: int, rare: int = RARE) -> DataFrame:
    """Pairs (a, b) across components within the buckets (key, id, leader, root, leader_root) that may be links; see the module, 4."""
    elements = sets.select("id", F.explode("set").alias("s"))
    few = elements.groupBy("s").agg(F.count("*").alias("df")).where(F.col("df") <= rare)
    ranked = elements.join(few, "s", "left").groupBy("id").agg(F.count("*").alias("n"), F.count("df").alias("few"), F.array_sort(F.collect_list(F.when(F.col("df").isNotNull(), F.struct("df", "s")))).alias("rare"))
    prefix = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    facts = stored(ranked.select("id", "n", (F.col("n") - F.col("few")).alias("e"), F.filter(F.slice("rare", F.lit(1), prefix), lambda x: x["df"] > 1).alias("prefix")), "facts")
    roots = buckets.select("id", "root").distinct()
    lists = facts.join(roots, "id").select("id", "root", F.explode("prefix").alias("x")).select("id", "root", F.col("x.s").alias("s"))
    side = lambda c: lists.select("s", F.col("id").alias(c), F.col("root").alias(f"r{c}"))
    meet = side("a").join(side("b"), "s").where("a < b and ra <> rb").select("a", "b")

    need = percent * (F.col("na") + F.col("nb"))
    able = facts.where(100 * F.col("e") >= percent * F.col("n")).select("id", "n", "e")
    rows = buckets.where("id <> leader").join(able, "id")
    probes = rows.where("root <> leader_root").select("key", F.col("id").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("e").alias("ea"))
    others = rows.select("key", F.col("id").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("e").alias("eb"), (F.col("root") == F.col("leader_root")).alias("first"))
    same = probes.join(others, "key").where((F.col("ra") != F.col("rb")) & (F.col("first") | (F.col("a") < F.col("b"))) & ((100 + percent) * F.col("ea") >= need) & ((100 + percent) * F.col("eb") >= need))
    return meet.union(same.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def prefix_pairs(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every pair (a, b) of sets that can be a link: shingles ordered from rare to common, both have a first common one in
    their prefixes (all but the last ``percent`` of the set, and one more), and their sizes allow it."""
    elements = sets.select("id", F.size("set").alias("n"), F.explode("set").alias("s"))
    several = elements.groupBy("s").agg(F.count("*").alias("df"))
    ranked = elements.join(several, "s").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("x"))
    prefix = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    lists = ranked.select("id", "n", F.explode(F.slice("x", F.lit(1), prefix)).alias("x")).where("x.df > 1").select("id", "n", F.col("x.s").alias("s"))
    side = lambda c: lists.select("s", F.col("id").alias(c), F.col("n").alias(f"n{c}"))
    meet = side("a").join(side("b"), "s").where(f"a < b and 100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return meet.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS, seed: int = SEED, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id is component_id) for each row. Ids are whole numbers.

    ``exact`` also looks for the few links that share no band (``prefix_pairs``), at the cost of lists of common shingles.
    """
    used: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        """Stored until the groups are known."""
        used.append(stored(df, name))
        return used[-1]

    sig = stored(signed(docs, id_col, text_col, shingle, rows, bands, seed), "signed")
    sets_known = sig.where("n > 0 and id is not null")
    reps = stored(sets_known.groupBy("lo", "hi").agg(F.min(F.struct("id", "n", "short", "keys")).alias("r")).select("lo", "hi", F.col("r.id").alias("rep"), "r.n", "r.short", "r.keys"), "reps")
    keyed = reps.select(F.col("rep").alias("id"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("k")).where("k > 1").select("key", "leader")
    buckets = kept(keyed.join(shared, "key"), "buckets")
    stars = kept(buckets.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    pairs = kept(plausible(stars, reps, percent), "pairs")
    full = lambda ids: kept(sets_of(docs, ids, ids.count(), id_col, text_col, shingle), "sets")
    ends = lambda p: kept(p.select(F.col("a").alias("id")).union(p.select("b")).distinct(), "ids")
    links = kept(confirmed(pairs, full(ends(pairs)), percent), "links")
    roots = components(links)
    root_of = lambda df, c, out: df.join(roots.select(F.col("node").alias(c), F.col("root").alias(out)), c, "left").withColumn(out, F.coalesce(out, c))
    leaders = kept(root_of(buckets.select("leader").distinct(), "leader", "leader_root"), "leaders")
    known = spread_join(root_of(buckets, "id", "root"), leaders, "leader", "id")
    open_ = known.groupBy("key").agg(F.max(F.col("root") != F.col("leader_root")).alias("open"), F.count("*").alias("k")).where("open and k > 2").select("key")
    rest = kept(known.join(open_, "key", "left_semi"), "rest")
    if not rest.isEmpty():
        sets = full(kept(rest.select("id").distinct(), "ids"))
        met = kept(plausible(kept(across(rest, sets, percent), "met"), reps, percent), "pairs")
        found = kept(confirmed(met, sets, percent), "found")
        if not found.isEmpty():
            links = kept(links.unionByName(found), "links")
            roots = components(links)
    if exact:
        sets = full(reps.select(F.col("rep").alias("id")))
        found = kept(confirmed(kept(prefix_pairs(sets, percent), "met"), sets, percent), "found")
        roots = components(links.unionByName(found))
    for table in used:
        remove(docs.sparkSession, table)
    out = sig.select("id", "n", "lo", "hi").join(reps.select("lo", "hi", "rep"), ["lo", "hi"], "left")
    out = out.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "rep", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents of a component other than its smallest id; all columns, same names and types."""
    name = private("gone")
    gone = stored(near_duplicates(docs, id_col=id_col, **options).where("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    n = gone.count()
    return docs.join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")
