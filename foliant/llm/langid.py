"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point alone. An n-gram's vector binds
(multiplies) its letters' vectors, each permuted (rotated) by its place. A text's vector bundles (adds)
the vectors of its n-grams; a language's prototype bundles the texts of that language, each scaled to
length 1. A text gets the language whose prototype has the largest cosine with its vector.

Text is lower-cased; every run of characters that are not letters is one space, and one space stands
at either end.

Training sums the texts' vectors as integers in each task and then in Spark, so the prototypes don't
depend on order; what reaches the driver is ``dims`` numbers for each language. Scoring shuffles nothing.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows with null lang are
not learned from; with nothing to learn from every text is ``und``; ties go to the smaller language name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filtered, per_text, small_batches, steps, texts_of

DIMS = 1024
N = 3
SEED = 20_240_611
#: Scaled vectors are summed as integers of this unit.
UNIT = 1 << 20
#: Texts whose vectors are made at once.
BLOCK = 128
#: n-gram vectors kept by a worker (2 KB each as float16 at 1,024 dimensions).
CACHE_GRAMS = 32_768
#: Least cosine of a text that a filter without learned bounds keeps (2.6 deviations of two random vectors).
MIN_SCORE = 0.08
#: A filter with learned bounds asks for this share of the cosine that all but this part of a language's own texts of
#: about the same size have.
LEAST_SHARE, LEAST_QUANTILE = 0.5, 0.05
#: Languages at most: a prototype of each goes to the workers (4 KB at 1,024 dimensions). More raise an error.
MAX_LANGS = 10_000

_letter: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letter


def letter_vector(cp: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, cp]).integers(0, 2, dims, dtype=np.int8) * 2 - 1


def gram_vector(letters: tuple[int, ...], vector) -> np.ndarray:
    """Product of the letters' vectors, the letter at place i rotated by len - 1 - i."""
    out = np.roll(vector(letters[0]), len(letters) - 1)
    for i, cp in enumerate(letters[1:], 1):
        out = out * np.roll(vector(cp), len(letters) - 1 - i)
    return out


class Encoder:
    """Texts to vectors. n-gram vectors are made once and kept, up to CACHE_GRAMS."""

    def __init__(self, dims: int = DIMS, n: int = N, seed: int = SEED):
        if not 1 <= n <= 3:
            raise ValueError("n must be from 1 to 3: a packed n-gram has 21 bits for each letter")
        self.dims, self.n, self.seed = dims, n, seed
        self.letters: dict[int, np.ndarray] = {}
        self.grams: dict[int, int] = {}
        self.table = np.empty((1024, dims), np.float16)

    def _vector(self, cp: int) -> np.ndarray:
        if cp not in self.letters:
            self.letters[cp] = letter_vector(cp, self.dims, self.seed)
        return self.letters[cp]

    def _rows(self, packed: np.ndarray) -> np.ndarray:
        wanted = packed.tolist()
        if len(self.grams) + len(wanted) > CACHE_GRAMS and len(self.grams) + sum(g not in self.grams for g in wanted) > CACHE_GRAMS:
            self.grams.clear()
        rows = np.empty(len(packed), np.int64)
        for j, g in enumerate(wanted):
            at = self.grams.get(g)
            if at is None:
                at = self.grams[g] = len(self.grams)
                if at >= len(self.table):
                    self.table = np.concatenate([self.table, np.empty((len(self.table), self.dims), np.float16)])
                self.table[at] = gram_vector(tuple(g >> 21 * (self.n - 1 - i) & 0x1FFFFF for i in range(self.n)), self._vector)
            rows[j] = at
        return rows

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """float32 [texts, dims]; zero for a text without letters."""
        out = np.zeros((len(texts), self.dims), np.float32)
        for a in range(0, len(texts), BLOCK):
            out[a : a + BLOCK] = self._block(texts[a : a + BLOCK])
        return out

    def _block(self, texts: list[bytes]) -> np.ndarray:
        codes, owner = [], []
        table = letter_table()
        for i, t in enumerate(texts):
            cps = np.frombuffer(t.decode(errors="replace").lower().encode("utf-32-le"), np.uint32).astype(np.int64)
            ok = table[cps]
            if not ok.any():
                continue
            cps = np.concatenate([[32], np.where(ok, cps, 32), [32]])
            cps = cps[np.concatenate([[True], (cps[1:] != 32) | (cps[:-1] != 32)])]
            m = len(cps) - self.n + 1
            if m <= 0:
                continue
            packed = cps[:m]
            for k in range(1, self.n):
                packed = packed << 21 | cps[k : k + m]
            grams, counts = np.unique(packed, return_counts=True)
            codes.append((grams, counts))
            owner.append(i)
        out = np.zeros((len(texts), self.dims), np.float32)
        if not codes:
            return out
        distinct, place = np.unique(np.concatenate([g for g, _ in codes]), return_inverse=True)
        # very many distinct n-grams (long texts in many scripts) go in slices, so that memory stays bounded
        counts = np.concatenate([c for _, c in codes]).astype(np.float32)
        row = np.repeat(owner, [len(g) for g, _ in codes])
        for s in range(0, len(distinct), CACHE_GRAMS):
            part = distinct[s : s + CACHE_GRAMS]
            mine = (place >= s) & (place < s + len(part))
            dense = np.zeros((len(texts), len(part)), np.float32)
            dense[row[mine], place[mine] - s] = counts[mine]
            out += dense @ self.table_rows(part)
        return out

    def table_rows(self, packed: np.ndarray) -> np.ndarray:
        rows = self._rows(packed)
        return self.table[rows].astype(np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(length > 0, length, 1)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = DIMS, n: int = N, seed: int = SEED) -> dict:
    """Prototypes from every row with a lang: {"langs": [...], "prototypes": [[float]], "dims", "n", "seed"}."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sums = Encoder(dims, n, seed), {}
        for batch in batches:
            texts, langs = texts_of(batch.column(1)), batch.column(0).to_pylist()
            for a, b in steps(texts):
                scaled = np.rint(unit(encode(texts[a:b])) * UNIT).astype(np.int64)
                mine = np.array(langs[a:b])
                for lang in set(langs[a:b]):
                    sums[lang] = sums.get(lang, 0) + scaled[mine == lang].sum(0)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dims), pa.array(np.arange(dims, dtype=np.int32)), pa.array(total)], names=["lang", "dim", "total"])

    rows = source.mapInArrow(run, "lang string, dim int, total bigint").groupBy("lang", "dim").agg(F.sum("total").alias("total")).limit(dims * MAX_LANGS + 1).collect()
    if len(rows) > dims * MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted({r.lang for r in rows})
    place = {lang: k for k, lang in enumerate(langs)}
    prototypes = np.zeros((len(langs), dims))
    for r in rows:
        prototypes[place[r.lang], r.dim] = r.total
    return {"langs": langs, "prototypes": unit(prototypes).astype(np.float32), "dims": dims, "n": n, "seed": seed}


def predictor(model: dict):
    """A maker of worker functions: texts -> (lang_pred, score); score is the cosine, at least 0."""

    def make():
        encode, langs, prototypes = Encoder(model["dims"], model["n"], model["seed"]), model["langs"], model["prototypes"]

        def work(texts: list[bytes]) -> tuple[list[str], np.ndarray]:
            vectors = encode(texts)
            some = vectors.any(1)
            if not langs:
                return ["und"] * len(texts), np.zeros(len(texts))
            cosines = unit(vectors) @ prototypes.T
            best = cosines.argmax(1)
            score = np.clip(cosines[np.arange(len(texts)), best].astype(np.float64), 0, 1)
            return [langs[k] if ok else "und" for k, ok in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, score, 0)

        return work

    return make


def identify(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred and score."""
    return per_text(docs, keep, text_col, [("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64())], predictor(model))


def size_class(n_bytes: int) -> int:
    """Texts of a class have sizes of the same number of binary digits, so the largest is less than twice the smallest."""
    return n_bytes.bit_length()


def bounds_by_size(low: dict[int, float], classes: int = 64) -> list[float]:
    """The bound for every class of size, from a low quantile of cosines for some: LEAST_SHARE of it. A class without texts of
    its own takes the nearest one's (the smaller of two as near), less by the root of the sizes' ratio if it is smaller: a text's
    cosine grows about so while it is short. Without any, MIN_SCORE."""
    if not low:
        return [MIN_SCORE] * classes
    out = []
    for c in range(classes):
        near = min(low, key=lambda k: (abs(k - c), k))
        out.append(LEAST_SHARE * low[near] * min(1.0, 2.0 ** ((c - near) / 2)))
    return out


def with_least(docs: DataFrame, model: dict, text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model with ``least``, the cosine that a text of each language and class of size needs, by the
    texts of ``docs`` (those it was learned from) that are its own; see ``bounds_by_size``."""
    own = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.length(F.bin(F.octet_length(F.col(f"`{text_col}`")).cast("long"))).alias("class"), F.col(f"`{text_col}`").alias("text")).where("lang is not null")
    rows = identify(own, model, ["lang", "class"]).where("lang = lang_pred").groupBy("lang", "class").agg(F.percentile_approx("score", LEAST_QUANTILE, 10_000).alias("low")).collect()
    low: dict[str, dict[int, float]] = {}
    for r in rows:
        low.setdefault(r.lang, {})[r["class"]] = r.low
    return model | {"least": {lang: bounds_by_size(low.get(lang, {})) for lang in model["langs"]}}


def keep_identified(docs: DataFrame, model: dict, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is known: not ``und``, and a cosine of at least the language's bound for the text's
    size (``with_least``), or of ``min_score`` if the model has no bounds."""
    make, least = predictor(model), model.get("least")

    def keep():
        work = make()

        def accept(texts: list[bytes]) -> np.ndarray:
            langs, score = work(texts)
            known = np.array(langs) != "und"
            need = np.array([least[x][size_class(len(t))] if ok else 0.0 for x, t, ok in zip(langs, texts, known.tolist(), strict=True)]) if least else min_score
            return known & (score >= need)

        return accept

    return filtered(docs, text_col, keep)
