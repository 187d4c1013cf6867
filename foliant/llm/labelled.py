"""A bounded sample of labelled rows, with what a classifier learns from; shared by the classifiers of this folder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_text

#: Labelled rows that a classifier is fitted on at most; of more, those whose hashed doc_id is smallest.
SAMPLE_ROWS = 8192
#: Bytes taken off a word's ends.
EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: bytes) -> set[bytes]:
    """Distinct words, A-Z lower-cased, without punctuation at their ends."""
    out = {w.strip(EDGES) for w in set(text.lower().split())}
    out.discard(b"")
    return out


def sample(labels: DataFrame, label: str, id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(sample_id, y) of at most ``rows`` labelled documents, the same on every run. Null ids and labels are left out; of several labels of a document the largest holds."""
    picked = labels.where(f"`{id_col}` is not null and `{label}` is not null").groupBy(F.col(f"`{id_col}`").alias("sample_id")).agg(F.max(label).cast("int").alias("y"))
    found = picked.orderBy(F.xxhash64("sample_id"), "sample_id").limit(rows).collect()
    spark = labels.sparkSession
    return spark.createDataFrame([(r.sample_id, r.y) for r in found], f"sample_id {labels.schema[id_col].dataType.simpleString()}, y int")


def gathered(docs: DataFrame, picked: DataFrame, extract: Callable[[bytes], list[int] | np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> tuple[list[np.ndarray], np.ndarray]:
    """(features, labels) of the sampled documents, in the same order on every run. ``picked`` is bounded, so it is broadcast."""
    mine = docs.select(F.col(f"`{id_col}`").alias("sample_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(picked), "sample_id")
    made = per_text(mine, ["sample_id", "y"], "text", [("x", T.ArrayType(T.LongType()), pa.list_(pa.int64()))], lambda: lambda texts: [[extract(t) for t in texts]])
    found = []  # views of the table's own memory: nothing is copied
    for batch in made.toArrow().to_batches():
        values, at = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
        found += [(i, y, values[a:b]) for i, y, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
    found.sort(key=lambda r: (r[0], r[1], len(r[2])))
    return [x for _, _, x in found], np.array([y for _, y, _ in found], float)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def copy_heads(rows: list[np.ndarray], y: np.ndarray, similarity: float = 0.5, bands: int = 8, per_band: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows of which none is a near copy of an earlier one, the mean label of each with its copies). Rows are sorted id arrays.

    A copied document then weighs no more than another, so that its words don't stand for its label. Candidates
    share a band of minima; a row joins the first row of a band that is similar enough (Jaccard).
    """
    rng = np.random.default_rng(17)
    a = rng.integers(0, 1 << 64, bands * per_band, dtype=np.uint64) | np.uint64(1)
    first: dict[tuple, int] = {}
    group = np.arange(len(rows))
    for i, r in enumerate(rows):
        if not len(r):
            key_list = [(-1,)]
        else:
            x = r.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            low = np.array([(x * k ^ (x >> np.uint64(29)) * k).min() for k in a]).reshape(bands, per_band)
            key_list = [(b, *low[b].tolist()) for b in range(bands)]
        for key in key_list:
            j = first.setdefault(key, i)
            if j != i and group[i] == i:
                both = len(np.intersect1d(r, rows[j], assume_unique=True))
                if both >= similarity * (len(r) + len(rows[j]) - both):
                    group[i] = group[j]
    heads, at = np.unique(group, return_inverse=True)
    return heads, np.bincount(at, y) / np.bincount(at)


def without_copies(rows: list[np.ndarray], y: np.ndarray, **options) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows at ``copy_heads``, with their mean labels."""
    heads, mean = copy_heads(rows, y, **options)
    return [rows[i] for i in heads], mean
