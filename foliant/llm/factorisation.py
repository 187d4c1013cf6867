"""Document quality by a factorisation machine.

A text is a sparse vector: its distinct words hashed to ``BUCKETS`` columns (scaled to length 1 together), its
structure statistics, and metadata (its length in bytes, in characters, in lines and in paragraphs). The score is the logistic of

    w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

which is every pairwise interaction <v_i, v_j> x_i x_j in time linear in the number of non-zero x_i. It is
fitted on the driver by Adam on a bounded sample of labelled rows; the model (BUCKETS + STATS columns of
FACTORS + 1 numbers) goes to the workers with the function. Scoring shuffles nothing.

Defined cases: null and empty texts have all statistics 0; with nothing to learn from every score is 0.5;
rows that repeat are scored each.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHE_WORDS, per_text
from .labelled import EDGES, SAMPLE_ROWS, gathered, sample, sigmoid

THRESHOLD = 0.7
BUCKETS = 1 << 14
FACTORS = 8
EPOCHS = 12
BATCH = 256
RATE = 0.02
L2_W, L2_V = 1e-3, 1e-3
SEED = 5
STATS = ("chars", "words", "word_length", "upper", "digits", "symbols", "punctuation", "pipes", "stops", "line_words", "dup_lines", "distinct_words", "loud_words", "marked_words", "characters", "lines", "paragraphs", "wide_characters")
#: A statistic, 0 to 1, is kept in a sampled row as a whole number of this unit.
UNIT = 1_000_000

_UPPER, _DIGIT, _SYMBOL, _PUNCT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>^~=+\\/_@{}[]", b".,;:!?'\"()-"
#: Bytes of UTF-8 that don't begin a character.
_REST = bytes(range(0x80, 0xC0))
_GAP = re.compile(rb"\n\s*\n")
_MARKED = re.compile(rb"[#*$%&<>]{2,}|!{2,}")


def _share(n: float, of: float) -> float:
    return n / of if of else 0.0


def statistics(text: bytes) -> list[float]:
    """Each from 0 to 1."""
    words, lines = text.split(), text.split(b"\n")
    size = len(text)
    count = lambda kind: size - len(text.translate(None, kind))
    full = [x for x in lines if x.strip()]
    chars = sum(map(len, words))
    characters = size - count(_REST)
    paragraphs = sum(1 for x in _GAP.split(text) if x.strip())
    return [
        min(1.0, math.log1p(size) / 14), min(1.0, math.log1p(len(words)) / 12), min(1.0, _share(chars, len(words)) / 20), _share(count(_UPPER), chars), _share(count(_DIGIT), chars), _share(count(_SYMBOL), chars), _share(count(_PUNCT), chars),
        min(1.0, _share(text.count(b"|"), len(words))), min(1.0, _share(text.count(b"."), len(words))), min(1.0, _share(len(words), len(full)) / 100), _share(len(full) - len(set(full)), len(full)),
        _share(len(set(words)), len(words)), _share(sum(w.isupper() for w in words), len(words)), min(1.0, _share(len(_MARKED.findall(text)), len(words))),
        min(1.0, math.log1p(characters) / 14), min(1.0, math.log1p(len(full)) / 10), min(1.0, math.log1p(paragraphs) / 8), _share(size - characters, size),
    ]


class Extractor:
    """Text -> (sorted distinct buckets, statistics)."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> tuple[list[int], list[float]]:
        out, cache = set(), self.cache
        for w in set(text.lower().split()):
            b = cache.get(w)
            if b is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                bare = w.strip(EDGES)
                b = cache[w] = zlib.crc32(bare) % BUCKETS if bare else -1
            if b >= 0:
                out.add(b)
        return sorted(out), statistics(text)


def extract(text: bytes) -> list[int]:
    """A sampled row: statistics in units first, then buckets."""
    buckets, stats = Extractor()(text)
    return [*(round(s * UNIT) for s in stats), *buckets]


def matrix(buckets: list[list[int]], stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the non-zero entries, by row."""
    k = stats.shape[1]
    sizes = np.array([len(b) for b in buckets], np.int64)
    row = np.concatenate([np.repeat(np.arange(len(buckets)), sizes), np.repeat(np.arange(len(buckets)), k)])
    col = np.concatenate([np.concatenate([*[np.array(b, np.int64) for b in buckets], np.empty(0, np.int64)]), np.tile(np.arange(BUCKETS, BUCKETS + k), len(buckets))])
    value = np.concatenate([np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes), stats.ravel()])
    order = np.argsort(row, kind="stable")
    return row[order], col[order], value[order]


def logits(model: dict, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores before the logistic, sums of v_if x_i by row). Every row has entries."""
    starts = np.searchsorted(row, np.arange(n))
    vx = model["v"][col] * value[:, None]
    sums = np.add.reduceat(vx, starts, axis=0)
    squares = np.add.reduceat((vx * vx).sum(1), starts)
    return model["w0"] + np.add.reduceat(model["w"][col] * value, starts) + 0.5 * ((sums * sums).sum(1) - squares), sums


def fit(rows: list[np.ndarray], y: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    rng, k = np.random.default_rng(seed), len(STATS)
    n = BUCKETS + k
    model = {"w0": 0.0, "w": np.zeros(n), "v": rng.normal(0, 0.05, (n, factors))}
    if not len(rows):
        return model | {"v": np.zeros((n, factors))}
    model["w0"] = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    moments = {key: [np.zeros_like(np.asarray(model[key], float)), np.zeros_like(np.asarray(model[key], float))] for key in model}
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            row, col, value = matrix([rows[i][k:].tolist() for i in part], np.array([rows[i][:k] for i in part]) / UNIT)
            z, sums = logits(model, row, col, value, len(part))
            g = (sigmoid(z) - y[part]) / len(part)
            gv = (g[row] * value)[:, None] * (sums[row] - model["v"][col] * value[:, None])
            cols, at = np.unique(col, return_inverse=True)
            grads = {"w0": np.array(g.sum()), "w": np.zeros(n), "v": np.zeros((n, factors))}
            grads["w"][cols] = np.bincount(at, g[row] * value, len(cols)) + L2_W * model["w"][cols]
            for f in range(factors):
                grads["v"][cols, f] = np.bincount(at, gv[:, f], len(cols)) + L2_V * model["v"][cols, f]
            t += 1
            step = RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for key, g_ in grads.items():
                m1, m2 = moments[key]
                m1 += 0.1 * (g_ - m1)
                m2 += 0.001 * (g_ * g_ - m2)
                model[key] = model[key] - step * m1 / (np.sqrt(m2) + 1e-8)
    model["w0"] = float(model["w0"])
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, **options) -> dict:
    """Fitted on at most ``rows`` of ``labels`` (doc_id, label)."""
    return fit(*gathered(docs, sample(labels, label, id_col, rows), extract, id_col, text_col), **options)


def score(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep``, score and predicted."""
    small = {"w0": model["w0"], "w": model["w"].astype(np.float32), "v": model["v"].astype(np.float32)}

    def make():
        extractor = Extractor()

        def work(texts: list[bytes]) -> list:
            made = [extractor(t) for t in texts]
            out = np.empty(len(texts))
            for a in range(0, len(texts), 512):
                part = made[a : a + 512]
                row, col, value = matrix([b for b, _ in part], np.array([s for _, s in part]))
                out[a : a + 512] = sigmoid(logits(small, row, col, value.astype(np.float32), len(part))[0])
            return [out]

        return work

    return per_text(docs, keep, text_col, [("score", T.DoubleType(), pa.float64())], make).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
