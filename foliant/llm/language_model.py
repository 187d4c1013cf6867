"""Word n-gram language model: interpolated modified Kneser-Ney, counted in Spark, scored from memory-mapped arrays.

The model has order ORDER (2 or 3). Words are lower-cased (A-Z); a text is its words and one end token; before the first
stand ORDER - 1 begin marks.

Counting reads the texts twice. The first pass counts words: each task adds up its own counts and sends them, sorted
and packed, to the shard of their hash; a shard writes its sorted hash array with the counts beside it. A
word's number comes from its place in these arrays, frequent words first (in CLASSES steps), so that packed n-grams are
small. The second pass counts the n-grams of the highest order, as (context, word),
the same way, by shard of the context's hash. What a shard has merged are the distinct n-grams; each
counts once for the n-gram without its first word, so the next lower order is counted from them (continuation counts), and
the lowest from that, without reading a text again.

The number of shards grows with the tokens (SHARD_TOKENS each), so what a task merges does not. Above FAN shards the
packed counts take two hops, so that no task makes more than FAN rows at a time. A context whose words are
so frequent that it may hold more than HOT shards' tokens is dealt over several shards by its following words; its totals
are added up from these when a text is scored. Only a few numbers a shard reach the driver.

Workers map the arrays into memory (page cache that all workers of a machine share) and look up each
step's distinct words and n-grams in sorted order. The arrays lie in the shared folder and are removed when
the driver exits.

P(w | c) = max(n(c, w) - D(n), 0) / n(c) + (D1 N1(c) + D2 N2(c) + D3 N3+(c)) / n(c) * P(w | c without its first word)
P(w)     = max(k(w) - D'(k), 0) / K + (D1' ... ) / K * 1 / (V + 1),  k(w): distinct words before w
n is the count at the highest order, below it the number of distinct words before the n-gram. A context that training has
not seen leaves the lower order; V + 1 makes room for the unknown word.

Defined cases: null text is empty and has the end token alone; with nothing to train on, V = N = 0 and
every token has probability 1 (1 / (V + 1)); texts that repeat count each time; words are bytes, UTF-8 or not; more than
2**32 - 3 distinct words raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .arrays import Opened, merged, pack, put, slices, unpack
from .common import HashCache, mix64, per_text, remove, scratch, shuffles_removed, small_batches, steps, stored, texts_of, word_hashes

ORDER = 3
#: Spaces occur in no word, so these are no word's hash but by accident.
END = xxhash.xxh64_intdigest(b" end")
#: Tokens for each shard, about.
SHARD_TOKENS = 1 << 22
#: Shards that a task sends rows to in one hop, and tasks among which the second hop deals what the first sent to one place.
FAN, SALTS = 4096, 16
#: A context that may have more tokens than so many shards have on average is dealt over several; and how many of its
#: commonest words a shard tells the driver to find these.
HOT, TOLD = 1, 64
#: Following words of a context up to which its totals are added up when it is looked up.
FEW = 3
#: Classes of words by frequency: each takes words 16 times as frequent as the one before.
CLASSES = 8
#: The number of a word that training has not seen; numbers are less.
UNKNOWN = 0xFFFFFFFF
_U = np.uint64


def modified_discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers n1..n4 of entries that occur 1..4 times; where one is 0, the plain absolute discount steps in."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2 if n2 else y
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return min(max(d1, 0.01), 1.0), min(max(d2, 0.01), 2.0), min(max(d3, 0.01), 3.0)


def discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def _classes(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def hash_bounds(shards: int) -> np.ndarray:
    return np.array([(i << 64) // shards for i in range(shards)], np.uint64)


def id_bounds(size: int, shards: int) -> np.ndarray:
    """First number of each shard of the numbers 0 .. size - 1."""
    return np.array([i * size // shards for i in range(shards)], np.uint64)


# --- n-grams as (context, word, count), sorted by context and word


def merged_grams(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal n-grams added; sorted."""
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64)
    context, word, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    distinct, at = np.unique(context, return_inverse=True)
    key = at.astype(np.uint64) << _U(32) | word
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return distinct[key[first] >> _U(32)], (key[first] & _U(UNKNOWN)).astype(np.uint32), np.add.reduceat(n, first) if len(key) else n


def _runs(context: np.ndarray) -> np.ndarray:
    """Where each context's run starts in sorted contexts."""
    return np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.empty(0, np.int64)


def _planes(a: np.ndarray, kind: str) -> bytes:
    return (a := a.astype(kind)).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def pack_grams(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> bytes:
    """Differences of contexts, lengths of their runs, words and counts by byte place, compressed."""
    first = _runs(context)
    data = _planes(np.diff(context[first], prepend=_U(0)), "<u8") + _planes(np.diff(first, append=len(context)), "<u4") + _planes(word, "<u4") + _planes(n, "<u4")
    return len(first).to_bytes(8, "little") + len(context).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(data)


def unpack_grams(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c, m = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[16:], max_output_size=12 * c + 8 * m or 1), np.uint8)
    out, at = [], 0
    for size, width, kind in ((c, 8, "<u8"), (c, 4, "<u4"), (m, 4, "<u4"), (m, 4, "<u4")):
        out.append(np.ascontiguousarray(data[at : at + size * width].reshape(width, size).T).view(kind).ravel())
        at += size * width
    return np.repeat(np.cumsum(out[0], dtype=np.uint64), out[1]), out[2], out[3].astype(np.int64)


class Found:
    """Counts that a task gathers; ``full`` says when to emit. ``merge`` adds up a list of parts."""

    def __init__(self, merge: Callable):
        self.merge, self.parts, self.n = merge, [], 0

    def add(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        self.n += len(part[0])
        if self.n > arrays.TASK_ENTRIES and len(self.parts) > 1:
            self.parts = [self.merge(self.parts)]
            self.n = len(self.parts[0][0])

    @property
    def full(self) -> bool:
        return self.n > arrays.TASK_ENTRIES

    def take(self) -> tuple[np.ndarray, ...]:
        out = self.merge(self.parts)
        self.parts, self.n = [], 0
        return out


class Grams:
    """Which shard an n-gram is in: that of its context's hash, or for a context of frequent words one of several from there on."""

    merge, pack, unpack = staticmethod(merged_grams), staticmethod(pack_grams), staticmethod(unpack_grams)

    def __init__(self, order: int, shards: int, often: tuple[np.ndarray, np.ndarray], share: int):
        self.order, self.shards, (self.often, self.counts), self.share = order, shards, often, share

    def parts(self, context: np.ndarray) -> np.ndarray:
        """Over how many shards each context is dealt. It has no more tokens than any of its words."""
        most = np.full(len(context), np.iinfo(np.int64).max)
        if not len(self.often) or self.shards == 1:
            return np.ones(len(context), np.int64)
        for k in range(self.order - 1):
            word = context >> _U(32 * k) & _U(UNKNOWN)
            at = np.minimum(np.searchsorted(self.often, word), len(self.often) - 1)
            most = np.minimum(most, np.where(self.often[at] == word, self.counts[at], 0))
        return np.clip(-(-most // self.share), 1, self.shards)

    def home(self, context: np.ndarray) -> np.ndarray:
        return ((mix64(context) >> _U(32)) * _U(self.shards) >> _U(32)).astype(np.int64)

    def route(self, context: np.ndarray, word: np.ndarray, *_: np.ndarray) -> np.ndarray:
        k = self.parts(context)
        part = np.where(k > 1, mix64(word.astype(np.uint64)) % k.astype(np.uint64), 0).astype(np.int64)
        return (self.home(context) + part) % self.shards


class Words:
    """Which shard a word's hash is in: that of its range."""

    merge, pack, unpack = staticmethod(merged), staticmethod(pack), staticmethod(unpack)

    def __init__(self, shards: int):
        self.shards, self.bounds = shards, hash_bounds(shards)

    def route(self, keys: np.ndarray, *_: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, keys, "right").astype(np.int64) - 1


def _emit(kind: Grams | Words, found: Found, step: int = 1) -> Iterator[tuple[int, bytes]]:
    """(shard // step, packed counts) of what was found."""
    got = found.take()
    if not len(got[0]):
        return
    shard = kind.route(*got) // step
    order = np.argsort(shard, kind="stable")
    cuts = _runs(shard[order])
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        mine = order[a:b]
        yield int(shard[mine[0]]), kind.pack(*(x[mine] for x in got))


def _batch(rows: Iterable[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for shard, blob in rows:
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], names=["shard", "blob"])


_BLOBS = "shard int, blob binary"


def _hops(kind: Grams | Words) -> int:
    """Shards that the first hop sends to one place."""
    return -(-kind.shards // FAN)


def _arrived(blobs: DataFrame, kind: Grams | Words) -> DataFrame:
    """What came to the first hop's places, dealt on to the shards."""
    if _hops(kind) == 1:
        return blobs

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(kind.merge)
        for batch in batches:
            for blob in batch.column(1):
                found.add(*kind.unpack(blob.as_py()))
                if found.full:
                    yield from _batch(_emit(kind, found))
        yield from _batch(_emit(kind, found))

    salted = blobs.withColumn("salt", F.spark_partition_id() % SALTS)
    return salted.repartition("shard", "salt").select("shard", "blob").mapInArrow(split, _BLOBS)


# --- texts


class Tokens:
    """Word hashes of texts, each followed by END."""

    def __init__(self):
        self.cache = HashCache()

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all texts in turn, number of tokens of each)"""
        words, n = [], np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            w = t.lower().split()
            n[i] = len(w) + 1
            words += w
            words.append(b" end")
        return word_hashes(words, self.cache), n


class Vocabulary:
    """Word numbers and counts from the mapped shards. A number is the first of the word's class and shard, and its rank in these."""

    def __init__(self, model: dict):
        self.bounds = hash_bounds(model["word_shards"])
        self.first, self.sizes = model["first"], model["sizes"]
        self.files = Opened(model["root"])

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, UNKNOWN where unknown; counts) of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), UNKNOWN, np.uint64), np.zeros(len(hashes), np.int64)
        for s, a, b in ranges(hashes, self.bounds):
            if not self.sizes[s]:
                continue
            f = self.files(f"words-{s}")
            at = np.minimum(np.searchsorted(f["keys"], hashes[a:b]), len(f["keys"]) - 1)
            ok = f["keys"][at] == hashes[a:b]
            counts[a:b][ok] = n = f["counts"][at[ok]]
            ids[a:b][ok] = (f["rank"][at[ok]] + self.first[word_classes(n), s]).astype(np.uint64)
        return ids, counts


def ranges(keys: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted keys for the parts that have some."""
    at = np.searchsorted(keys, bounds)
    at[0], ends = 0, np.append(at[1:], len(keys))
    for s in np.flatnonzero(ends > at).tolist():
        yield s, int(at[s]), int(ends[s])


def word_classes(counts: np.ndarray) -> np.ndarray:
    """0 for the most frequent words."""
    return CLASSES - 1 - np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64) // 4, CLASSES - 1)


def numbered(hashes: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, word counts) of tokens in order."""
    distinct, place = np.unique(hashes, return_inverse=True)
    ids, counts = vocabulary(distinct)
    return ids[place], counts[place]


def contexts(ids: np.ndarray, n: np.ndarray, begin: int, size: int) -> np.ndarray:
    """The ``size`` words before each token, packed with the nearest lowest; ``begin`` stands before a text."""
    place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros(len(ids), np.uint64)
    for k in range(size, 0, -1):
        before = np.full(len(ids), begin, np.uint64)
        some = place >= k
        before[some] = ids[np.flatnonzero(some) - k]
        out = out << _U(32) | before
    return out


# --- training


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER, word_shards: int | None = None, shards: int | None = None) -> dict:
    """Counts every text of ``docs`` and writes the model; returns what workers need to open it."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3: a packed context has 32 bits for each word")
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(f"`{text_col}`").alias("text"))
    root = scratch(spark, "lm")
    kind = Words(word_shards or max(1, 2 * source.rdd.getNumPartitions()))

    def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, found = Tokens(), Found(merged)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in steps(texts):
                keys, counts = np.unique(tokens(texts[a:b])[0], return_counts=True)
                found.add(keys, counts.astype(np.int64))
                if found.full:
                    yield from _batch(_emit(kind, found, _hops(kind)))
        yield from _batch(_emit(kind, found, _hops(kind)))

    def write_words(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        keys, counts = merged([unpack(b.as_py()) for b in table["blob"]])
        kinds = word_classes(counts)
        order = np.argsort(kinds, kind="stable")
        sizes = np.bincount(kinds, minlength=CLASSES)
        rank = np.empty(len(keys), np.uint32)
        rank[order] = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        put(f"{root}/words-{s}", {"keys": keys, "counts": counts, "rank": rank})
        top = np.argsort(-counts, kind="stable")[:TOLD]
        row = {"shard": s, "sizes": sizes.tolist(), "total": int(counts.sum()), "texts": int(counts[keys == END].sum()), "kinds": kinds[top].tolist(), "ranks": rank[top].tolist(), "counts": counts[top].tolist()}
        return pa.Table.from_pylist([row], pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int64())), ("total", pa.int64()), ("texts", pa.int64()), *[(n, pa.list_(pa.int64())) for n in ("kinds", "ranks", "counts")]]))

    out = "shard int, sizes array<bigint>, total long, texts long, kinds array<bigint>, ranks array<bigint>, counts array<bigint>"
    with shuffles_removed(spark):
        rows = _arrived(source.mapInArrow(count_words, _BLOBS), kind).groupBy("shard").applyInArrow(write_words, out).collect()
    sizes = np.zeros((CLASSES, kind.shards), np.int64)
    for r in rows:
        sizes[:, r.shard] = r.sizes
    first = (np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(sizes.shape)
    model = {"root": root, "order": order, "word_shards": kind.shards, "first": first, "sizes": sizes.sum(0), "tokens": sum(r.total for r in rows)}
    v = model["words"] = int(sizes.sum())
    if not v:
        return model
    if v > UNKNOWN - 2:
        raise ValueError(f"{v} distinct words: a packed n-gram has 32 bits for each")
    begin = v  # the begin mark's number
    shards = shards or max(1, -(-model["tokens"] // SHARD_TOKENS))
    share = max(1, int(HOT * model["tokens"] // shards))
    often = {int(first[k, r.shard]) + i: n for r in rows for k, i, n in zip(r.kinds, r.ranks, r["counts"], strict=True) if n > share} | {begin: sum(r.texts for r in rows) * (order - 1)}
    often = (np.array(sorted(often), np.uint64), np.array([often[k] for k in sorted(often)], np.int64))
    kinds = model["kinds"] = {n: Grams(n, shards, often, share) for n in range(2, order + 1)}

    def count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, found, vocabulary, kind = Tokens(), Found(merged_grams), Vocabulary(model), kinds[order]
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in steps(texts):
                hashes, n = tokens(texts[a:b])
                ids, _ = numbered(hashes, vocabulary)
                found.add(*merged_grams([(contexts(ids, n, begin, order - 1), ids.astype(np.uint32), np.ones(len(ids), np.int64))]))
                if found.full:
                    yield from _batch(_emit(kind, found, _hops(kind)))
        yield from _batch(_emit(kind, found, _hops(kind)))

    def writer(n: int) -> Callable[[pa.Table], pa.Table]:
        """Writes a shard of order n; its rows: how many n-grams it has (shard -1), and packed counts for the next lower order."""

        def write(table: pa.Table) -> pa.Table:
            s = table["shard"][0].as_py()
            context, word, counts = merged_grams([unpack_grams(b.as_py()) for b in table["blob"]])
            first = _runs(context)
            size = np.diff(first, append=len(context))
            many = np.flatnonzero(size > FEW)
            sums = lambda x: np.add.reduceat(x, first)[many] if len(first) else x
            put(
                f"{root}/grams{n}-{s}",
                {
                    "context": context[first], "start": np.append(first, len(context)).astype(np.uint32), "word": word, "count": np.minimum(counts, 255).astype(np.uint8),
                    "large": np.flatnonzero(counts >= 255), "large_count": counts[counts >= 255], "many": many, "total": sums(counts), **{f"n{k}": sums(np.where(np.minimum(counts, 3) == k, 1, 0)) for k in (1, 2, 3)},
                },
            )
            out = [(-1, s, len(context), *_classes(counts), None)]
            if n > 2:
                found, lower = Found(merged_grams), kinds[n - 1]
                found.add(*merged_grams([(context & _U((1 << 32 * (n - 2)) - 1), word, np.ones(len(context), np.int64))]))
                out += [(i, s, 0, 0, 0, 0, 0, blob) for i, blob in _emit(lower, found, _hops(lower))]
            else:
                words, k = np.unique(word, return_counts=True)
                out += [(i, s, 0, 0, 0, 0, 0, blob) for i, blob in slices(words.astype(np.uint64), k, id_bounds(v, shards))]
            return pa.table({name: pa.array(c, t) for name, t, c in zip(("shard", "part", "n", "c1", "c2", "c3", "c4", "blob"), (pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()), zip(*out, strict=True), strict=True)})

        return write

    def write_lowest(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        keys, counts = merged([unpack(b.as_py()) for b in table["blob"]])
        bounds = id_bounds(v, shards)
        lo, hi = int(bounds[s]), int(bounds[s + 1]) if s + 1 < shards else v
        dense = np.zeros(hi - lo, np.uint32)
        dense[keys.astype(np.int64) - lo] = counts
        put(f"{root}/lowest-{s}", {"k": dense})
        return pa.table({"n": pa.array([int((counts >= 3).sum())]), **{f"c{i + 1}": pa.array([x]) for i, x in enumerate(_classes(counts))}})

    blobs, before = source.mapInArrow(count_grams, _BLOBS), None
    model["shards"], model["d"], model["there"] = shards, {}, {}
    for n in range(order, 1, -1):
        out = "shard int, part int, n long, c1 long, c2 long, c3 long, c4 long, blob binary"
        made = stored(_arrived(blobs, kinds[n]).groupBy("shard").applyInArrow(writer(n), out), f"lm-{n}")
        told = made.where("shard < 0").drop("blob").collect()
        model["d"][n] = modified_discounts([sum(r[c] for r in told) for c in ("c1", "c2", "c3", "c4")])
        model["there"][n] = {r.part for r in told}
        model["types"] = sum(r.n for r in told)  # at last the pairs
        if before is not None:
            remove(spark, before)
        blobs, before = made.where("shard >= 0").select("shard", "blob"), made
    with shuffles_removed(spark):
        lowest = blobs.groupBy("shard").applyInArrow(write_lowest, "n long, c1 long, c2 long, c3 long, c4 long").agg(*[F.sum(c).alias(c) for c in ("n", "c1", "c2", "c3", "c4")]).first()
    remove(spark, before)
    d = model["d"][1] = modified_discounts([lowest.c1, lowest.c2, lowest.c3, lowest.c4])
    model["rest"] = (d[0] * lowest.c1 + d[1] * lowest.c2 + d[2] * lowest.n) / model["types"]
    return model


# --- scoring


class Scorer:
    """log10 probabilities of texts under a trained model."""

    def __init__(self, model: dict):
        self.model, self.tokens, self.vocabulary = model, Tokens(), Vocabulary(model)
        self.files = Opened(model["root"])

    def _lowest(self, ids: np.ndarray) -> np.ndarray:
        """P(w) of sorted distinct numbers."""
        m = self.model
        out = np.full(len(ids), m["rest"] / (m["words"] + 1))
        bounds = id_bounds(m["words"], m["shards"])
        for s, a, b in ranges(ids[ids < m["words"]], bounds):
            k = self.files(f"lowest-{s}")["k"][(ids[a:b] - bounds[s]).astype(np.int64)].astype(np.int64)
            out[a:b] += np.maximum(k - discount(k, m["d"][1]), 0) / m["types"]
        return out

    @staticmethod
    def _counts(f: dict, at: np.ndarray) -> np.ndarray:
        n = f["count"][at].astype(np.int64)
        if len(f["large"]) and (big := n == 255).any():
            n[big] = f["large_count"][np.searchsorted(f["large"], at[big])]
        return n

    def _totals(self, f: dict, c: np.ndarray) -> np.ndarray:
        """[contexts, 4]: the count, and the words that follow once, twice, more often, of a shard's contexts (by place)."""
        out = np.zeros((len(c), 4), np.int64)
        low, size = f["start"][c].astype(np.int64), f["start"][c + 1].astype(np.int64) - f["start"][c]
        for k in range(FEW):
            some = np.flatnonzero((size > k) & (size <= FEW))
            n = self._counts(f, low[some] + k)
            out[some, 0] += n
            out[some, np.minimum(n, 3)] += 1
        if len(more := np.flatnonzero(size > FEW)):
            at = np.searchsorted(f["many"], c[more])
            out[more] = np.stack([f[x][at] for x in ("total", "n1", "n2", "n3")], 1)
        return out

    @staticmethod
    def _found(f: dict, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each of sorted distinct contexts in a shard, whether it is there)"""
        at = np.minimum(np.searchsorted(f["context"], context), len(f["context"]) - 1)
        return at, f["context"][at] == context

    def _grams(self, n: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first term, weight of the lower order) of distinct n-grams, sorted by context and word."""
        m, kind, there = self.model, self.model["kinds"][n], self.model["there"][n]
        first = _runs(context)
        distinct, of = context[first], np.repeat(np.arange(len(first)), np.diff(first, append=len(context)))
        parts, home = kind.parts(distinct), kind.home(distinct)
        totals, count = np.zeros((len(distinct), 4), np.int64), np.zeros(len(context), np.int64)
        shard = np.where(parts[of] > 1, kind.route(context, word), home[of])
        order = np.argsort(shard, kind="stable")
        cuts = _runs(shard[order])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            mine = order[a:b]
            if int(shard[mine[0]]) not in there:
                continue
            f = self.files(f"grams{n}-{int(shard[mine[0]])}")
            runs = _runs(of[mine])
            here = of[mine[runs]]  # distinct contexts, by place
            at, ok = self._found(f, distinct[here])
            whole = ok & (parts[here] == 1)
            totals[here[whole]] = self._totals(f, at[whole])
            each = np.repeat(np.arange(len(runs)), np.diff(runs, append=len(mine)))
            some = np.flatnonzero(ok[each])
            # binary search for the word in each context's run, all n-grams at once; most runs are short
            c, want, words = at[each[some]], word[mine[some]], f["word"]
            low, high = f["start"][c].astype(np.int64), f["start"][c + 1].astype(np.int64)
            end, open_ = high.copy(), np.arange(len(c))
            while len(open_):
                middle = (low[open_] + high[open_]) >> 1
                less = words[middle] < want[open_]
                low[open_[less]] = middle[less] + 1
                high[open_[~less]] = middle[~less]
                open_ = open_[low[open_] < high[open_]]
            hit = np.flatnonzero((low < end) & (words[np.minimum(low, len(words) - 1)] == want))
            count[mine[some[hit]]] = self._counts(f, low[hit])
        split = np.flatnonzero(parts > 1)
        for j in range(int(parts[split].max(initial=0))):  # contexts dealt over several shards: their parts' totals together
            mine = split[parts[split] > j]
            place = (home[mine] + j) % kind.shards
            for s in np.unique(place).tolist():
                if s in there:
                    some, f = mine[place == s], self.files(f"grams{n}-{s}")
                    at, ok = self._found(f, distinct[some])
                    totals[some[ok]] += self._totals(f, at[ok])
        total, d = np.maximum(totals[:, 0], 1), m["d"][n]
        weight = np.where(totals[:, 0] > 0, (totals[:, 1] * d[0] + totals[:, 2] * d[1] + totals[:, 3] * d[2]) / total, 1.0)
        return np.maximum(count - discount(count, d), 0) / total[of], weight[of]

    def probabilities(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """P(word | context) of numbers; a context holds the order's words less one, packed."""
        distinct, at = np.unique(word, return_inverse=True)
        p = self._lowest(distinct)[at]
        for n in range(2, self.model["order"] + 1):
            c, of = np.unique(context & _U((1 << 32 * (n - 1)) - 1), return_inverse=True)
            keys, back = np.unique(of.astype(np.uint64) << _U(32) | word, return_inverse=True)
            direct, weight = self._grams(n, c[keys >> _U(32)], (keys & _U(UNKNOWN)).astype(np.uint32))
            p = direct[back] + weight[back] * p
        return p

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """[tokens, known tokens, unigram add-one log10, model log10] of each text."""
        m = self.model
        hashes, n = self.tokens(texts)
        if not m["words"]:
            return [n, np.zeros_like(n), np.zeros(len(n)), np.zeros(len(n))]
        first = np.cumsum(n) - n
        ids, counts = numbered(hashes, self.vocabulary)
        base = np.log10((counts + 1) / (m["tokens"] + m["words"] + 1))
        p = self.probabilities(contexts(ids, n, m["words"], m["order"] - 1), ids)
        return [n, np.add.reduceat((ids != _U(UNKNOWN)).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)]


def score(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, n_tokens, n_known, train_tokens, base_score, score and perplexity of every text."""
    fields = [("n_tokens", T.LongType(), pa.int64()), ("n_known", T.LongType(), pa.int64()), ("base_score", T.DoubleType(), pa.float64()), ("score", T.DoubleType(), pa.float64())]
    out = per_text(docs, keep, text_col, fields, lambda: Scorer(model))
    return out.select(*keep, "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
