"""Mixing sources to target weights by the cube method (balanced sampling).

Every source gets a target of words. A document of a source whose target is r times its size is taken
floor(r) times, and once more with probability r - floor(r). Which documents get the extra copy is drawn
by the cube method: inclusion probabilities move through the null space of the balancing constraints
(number of documents, number of words) until each is 0 or 1, so totals stay as they are; in the flight
three documents at a time are enough for two constraints. The one or two documents of a source that
cannot be settled this way are the landing problem: they are rounded to what comes nearest the target.

The flight runs in blocks of ``BLOCK_ROWS`` documents (a large source is dealt over many blocks by a
hash of doc_id). A block leaves two documents at most; these meet in blocks of a next round, until a
source's leftovers fit into one. No task sees more than a block, whatever the size of a source.

Defined cases: null text has size 0 and is never taken, as is a text without words; null source is a
source of its own and comes last; the draw depends on (doc_id, size) and the seed alone, so reruns and
other partitionings agree; rows that repeat are documents of their own, and where so many share a doc_id (or have none)
that they would crowd a block, their place in the stored table deals them over the blocks; an empty table gives none.
There may be MAX_SOURCES sources at most, as one row for each reaches the driver; more raise an error.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import private, stored

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3.0
BLOCK_ROWS = 8192
MAX_SOURCES = 1_000_000
SEED = 7
_EPS = 1e-9


def targets(sizes: list[int], weights: Iterable[float], share: float = 1.0, max_repeat: float = MAX_REPEAT) -> list[float]:
    """Words for each source: ``share`` of all by weight, at most max_repeat times a source's size; what is above is shared again by weight."""
    w, limit = np.array(list(weights), float), np.array(sizes, float) * max_repeat
    out, free, rest = np.zeros(len(sizes)), np.ones(len(sizes), bool), share * float(sum(sizes))
    while free.any():
        want = np.where(free, rest * w / w[free].sum(), 0)
        above = free & (want > limit)
        if not above.any():
            out[free] = want[free]
            break
        out[above] = limit[above]
        rest -= limit[above].sum()
        free &= ~above
    return out.tolist()


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: sums of p and of p * size stay, all but two are 0 or 1."""
    p = p.copy()
    scale = size / max(1.0, float(size.max(initial=1)))
    active: list[int] = []
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            continue
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        # the null space of rows (1, 1, 1) and (x_a, x_b, x_c)
        u = (scale[b] - scale[c], scale[c] - scale[a], scale[a] - scale[b])
        if max(map(abs, u)) < 1e-12:
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[i]) / v if v > 0 else p[i] / -v) for i, v in zip(active, u, strict=True) if abs(v) > 1e-15)
        down = min((p[i] / v if v > 0 else (1 - p[i]) / -v) for i, v in zip(active, u, strict=True) if abs(v) > 1e-15)
        step = up if rng.random() * (up + down) < down else -down
        for i, v in zip(active, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + step * v))
        active = [i for i in active if _EPS < p[i] < 1 - _EPS]
    return np.where(p <= _EPS, 0.0, np.where(p >= 1 - _EPS, 1.0, p))


def landing(p: np.ndarray, size: np.ndarray, want: float) -> np.ndarray:
    """0 or 1 for the few documents still open: of all ways, the one whose words come nearest ``want``; of equals, the first."""
    open_ = [i for i in range(len(p)) if 0 < p[i] < 1]
    out, base = np.where(p >= 1, 1.0, 0.0), float((np.where(p >= 1, 1.0, 0.0) * size).sum())
    if open_:
        best = min(range(1 << len(open_)), key=lambda m: abs(base + sum(size[i] for k, i in enumerate(open_) if m >> k & 1) - want))
        for k, i in enumerate(open_):
            out[i] = best >> k & 1
    return out


def words_in(text_col: str):
    return F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _flier(names: list[str], by: list[str], seed: int, round_: int, last: bool):
    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        """One block's flight; in the last round a block is all that is left of its source, and lands."""
        pdf = pdf.sort_values(["h", *by, "size"], kind="stable", ignore_index=True)
        rng = np.random.default_rng([seed, round_, int(pdf["source_no"].iloc[0]), int(pdf["block"].iloc[0])])
        p, size = pdf["p"].to_numpy(float), pdf["size"].to_numpy(float)
        p = flight(p, size, rng)
        if last:
            p = landing(p, size, float(pdf["want"].iloc[0]))
        return pdf.assign(p=p)[names]

    return fly


def _rounds(rows: DataFrame, ids: list[str], block_rows: int, seed: int) -> DataFrame:
    """rows(source_no, ids, draw, tie, size, p, n, want, ...): the same with p settled to 0 or 1."""
    schema = rows.schema
    settled: list[DataFrame] = []
    round_ = 0
    while True:
        most = rows.agg(F.max("n")).first()[0] or 0
        last = most <= block_rows

        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows))
        dealt = rows.withColumn("h", F.xxhash64("draw", "tie", F.lit(seed + round_))).withColumn("block", F.pmod(F.col("h"), blocks))
        flown = dealt.groupBy("source_no", "block").applyInPandas(_flier(schema.names, [*ids, "tie"], seed, round_, last), schema)
        if last:
            settled.append(flown)
            break
        flown = stored(flown, f"mix{round_}")
        settled.append(flown.where("p = 0 or p = 1"))
        rest = flown.where("p > 0 and p < 1")
        # what is still to come of a source's extra words, and how many documents are left
        done = flown.groupBy("source_no").agg(F.sum(F.when(F.col("p") == 1, F.col("size")).otherwise(0)).alias("got"), F.sum(F.when((F.col("p") > 0) & (F.col("p") < 1), 1).otherwise(0)).alias("left"))
        rows = rest.drop("n").join(done, "source_no").withColumns({"n": F.col("left").cast("long"), "want": F.col("want") - F.col("got")}).select(*schema.names)
        round_ += 1
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def _tied(sized: DataFrame, block_rows: int) -> DataFrame:
    """``sized`` with ``tie``: the row's number where more rows share its ``draw`` than an eighth of a block has, else 0."""
    crowd, many = private("draw"), private("rows")
    crowds = stored(sized.where("size > 0").groupBy(F.col("draw").alias(crowd)).agg(F.count("*").alias(many)).where(F.col(many) > block_rows // 8).select(crowd), "crowds")
    if crowds.isEmpty():
        return sized.withColumn("tie", F.lit(0).cast("long"))
    joined = sized.join(crowds, F.col("draw") == F.col(crowd), "left")
    return joined.withColumn("tie", F.when(F.col(crowd).isNotNull(), F.col("row")).otherwise(0)).drop(crowd)


def _mix(docs: DataFrame, ids: list, draw, text_col: str, source_col: str, weights, share: float, max_repeat: float, block_rows: int, seed: int) -> DataFrame:
    """The ids (columns i0, i1, ...), size, source_size, target, copies of every row; ``draw`` is what the draw depends on."""
    spark = docs.sparkSession
    names = [f"i{k}" for k in range(len(ids))]
    sized = stored(
        docs.select(*[c.alias(n) for c, n in zip(ids, names, strict=True)], F.xxhash64(draw).alias("draw"), F.col(f"`{source_col}`").alias("source"), words_in(text_col).alias("size"), F.monotonically_increasing_id().alias("row")),
        "sizes",
    )
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n"))
    sources = by_source.limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources.sort(key=lambda r: (r.source is None, r.source or ""))
    goal = targets([r.source_size for r in sources], [weights[i % len(weights)] for i in range(len(sources))], share, max_repeat)
    table = []
    for i, (r, t) in enumerate(zip(sources, goal, strict=True)):
        ratio = t / r.source_size if r.source_size else 0.0
        whole = int(ratio + _EPS)
        table.append((i, r.source, r.source_size, float(t), whole, max(0.0, ratio - whole), r.n, float(t) - whole * r.source_size))
    plan = spark.createDataFrame(table, f"source_no int, plan_source {docs.schema[source_col].dataType.simpleString()}, source_size long, target double, whole int, p double, n long, want double")
    joined = _tied(sized, block_rows).join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    columns = ["source_no", *names, "draw", "tie", "size", "p", "n", "want", "whole", "source_size", "target"]
    some = _rounds(joined.where("size > 0").select(columns), names, block_rows, seed)
    none = joined.where("size = 0").select(columns).withColumn("p", F.lit(0.0))
    return some.unionByName(none).select(*names, "size", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.0, max_repeat: float = MAX_REPEAT, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of the document). weights repeat over the sources in order of their names.

    One row for each source reaches the driver; documents never do.
    """
    id_ = F.col(f"`{id_col}`")
    out = _mix(docs, [id_], id_, text_col, source_col, weights, share, max_repeat, block_rows, seed)
    return out.select(F.col("i0").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def _placed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table with two columns that say where each row is stored, and their names: the file's name and the row's number in it,
    which no plan or partitioning changes. What is not read from Parquet files is stored first."""
    file, row = private("file"), private("row")
    for table in (docs, None):
        table = stored(docs, "numbered") if table is None else table
        try:
            if "_metadata" not in (c.lower() for c in table.columns):
                return table.select(*[F.col(f"`{c}`") for c in table.columns], F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)), [file, row]
        except AnalysisException:
            pass
    numbered = stored(docs.withColumns({file: F.lit(""), row: F.monotonically_increasing_id()}), "numbered")
    return numbered, [file, row]


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.0, max_repeat: float = MAX_REPEAT, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them: each row so many times as it is taken, all columns as they are.

    Rows are matched by where they are stored, as doc_id may repeat or be null; see ``_placed``.
    """
    columns = docs.columns
    placed, (file, row) = _placed(docs)
    mixed_rows = _mix(placed, [F.col(file), F.col(row)], F.col(f"`{id_col}`"), text_col, source_col, weights, share, max_repeat, block_rows, seed)
    f, r, copies = private("f"), private("r"), private("copies")
    picks = mixed_rows.where("copies > 0").select(F.col("i0").alias(f), F.col("i1").alias(r), F.col("copies").alias(copies))
    taken = placed.join(picks, (F.col(file) == F.col(f)) & (F.col(row) == F.col(r))).withColumn(private("copy"), F.explode(F.sequence(F.lit(1), F.col(copies))))
    return taken.select(*[F.col(f"`{c}`") for c in columns])
