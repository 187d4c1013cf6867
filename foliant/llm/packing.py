"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best-fit: at most ``open_bins`` sequences are open at a time. Open sequences are
kept by their free space, and a bitset (one bit for each amount of free space) finds the tightest fit
with one shift and one lowest-set-bit. When a piece fits nowhere and all places are taken, the fullest
open sequence closes. Pieces of a step reach the packer longest first.

Tokenising and packing run in one pass over the input's own partitions: no text is shuffled, the state
of a task is bounded by ``open_bins`` and a task that is run again over the same split gives the same
sequences. What is open at the end of a partition is marked. In a second pass the pieces of all these sequences (numbers,
no texts) are dealt over groups, so many that the open places of a packer hold a group's tokens, and packed
again, longest first. So the number of partitions costs hardly a sequence.

Defined cases: null and empty texts are one piece that holds only the end token; rows that repeat are
packed each; an empty table gives an empty result; other columns of the input are not read; bytes that are not UTF-8 are
read as replacement characters.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc, small_batches, steps, stored, texts_of

SEQUENCE_TOKENS = 1024
OPEN_BINS = 4096
END_ID = 2
#: So many places of pieces that were packed again are broadcast (32 bytes each); more are joined by a shuffle.
BROADCAST_PLACES = 500_000


class BestFit:
    """Places pieces; ``add`` returns (sequence, offset). Sequences are numbered from 0."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.n_open = self.made = 0

    def add(self, length: int) -> tuple[int, int]:
        if length == self.capacity:
            self.made += 1
            return self.made - 1, 0
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, bin_ = self.capacity, self.made
            self.made += 1
        if left := free - length:
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
            self.n_open += 1
        return bin_, self.capacity - free

    def left(self) -> list[tuple[int, int]]:
        """(sequence, tokens) of what is open."""
        return [(b, self.capacity - free) for free, bins in enumerate(self.by_free) for b in bins]

    def _take(self, free: int) -> int:
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return bin_


class TokenIds:
    """Ids of texts as the ``tokenizers`` file gives them with add_special_tokens=False.

    The same vocabulary as ranks is read by ``tiktoken``, which gives the same ids several times faster
    (tests hold them together); a text that spells a special token goes to ``tokenizers`` itself.
    """

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(f"{name}.tiktoken"), "rb"))}  # noqa: SIM115
        self.fast = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(P.path(f"{name}.json"))
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


_OUT = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
#: Number of a row that stands for an open sequence, with its tokens as length.
_MARK = -1


def _again(made: DataFrame, capacity: int, open_bins: int) -> DataFrame:
    """The pieces of ``made`` (rows of pieces and marks), those of open sequences packed again."""
    pieces, marks = made.where(F.col("piece") != _MARK), made.where(F.col("piece") == _MARK).select("sequence_id", "length")
    n, tokens = marks.agg(F.count("*"), F.sum("length")).first()
    if n < 2:
        return pieces
    groups = -(-tokens // (open_bins * capacity))
    mine = marks.select("sequence_id")
    left = pieces.select("sequence_id", "offset", "length").join(F.broadcast(mine) if n <= BROADCAST_PLACES else mine, "sequence_id")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], ignore_index=True)
        packer = BestFit(capacity, open_bins)
        placed = np.array([packer.add(x) for x in pdf["length"].tolist()], np.int64).reshape(-1, 2)
        # numbers below 0 are no partition's
        return pd.DataFrame({"sequence_id": pdf["sequence_id"], "offset": pdf["offset"], "new_sequence": -1 - placed[:, 0] - (int(pdf["g"].iloc[0]) << 40), "new_offset": placed[:, 1]})

    dealt = left.withColumn("g", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
    placed = stored(dealt.groupBy("g").applyInPandas(place, "sequence_id bigint, offset bigint, new_sequence bigint, new_offset bigint"), "placed")
    joined = pieces.join(F.broadcast(placed) if placed.count() <= BROADCAST_PLACES else placed, ["sequence_id", "offset"], "left")
    return joined.withColumns({"sequence_id": F.coalesce("new_sequence", "sequence_id"), "offset": F.coalesce("new_offset", "offset")}).select(*made.columns)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, end_id: int = END_ID, tokenizer: str = "byte_bpe_50k", with_ids: bool = False
) -> DataFrame:
    """One row for each piece of each document: its place in the document and in its sequence.

    ``with_ids`` adds the piece's ids. See the module for the method and the defined cases.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = _OUT.format(id=source.schema["doc_id"].dataType.simpleString()) + (", ids array<int>" if with_ids else "")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, base = TokenIds(tokenizer), BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in steps(texts):
                doc, piece, start, length, sums, kept = [], [], [], [], [], []
                for i in range(a, b):
                    ids = np.array([*encode(texts[i].decode(errors="replace")), end_id], dtype="<u4")
                    data = ids.tobytes()
                    for k, (s, n) in enumerate(cut(len(ids), capacity)):
                        doc.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        sums.append(crc(data[4 * s : 4 * (s + n)]))
                        if with_ids:
                            kept.append(ids[s : s + n].astype(np.int32))
                sequence, offset = [0] * len(doc), [0] * len(doc)
                for i in sorted(range(len(doc)), key=length.__getitem__, reverse=True):
                    sequence[i], offset[i] = packer.add(length[i])
                columns = [
                    batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64()),
                    pa.array(np.array(sequence, np.int64) + base), pa.array(offset, pa.int64()), *([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                kind = columns[0].type
        if left := packer.left():
            n = len(left)
            nulls = pa.nulls(n, pa.int64())
            numbers = [pa.array([x[k] for x in left], pa.int64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, kind), pa.array([_MARK] * n, pa.int32()), nulls, numbers[1], nulls, pc.add(numbers[0], base), nulls, *([pa.nulls(n, pa.list_(pa.int32()))] if with_ids else [])], names=names
            )

    return _again(stored(source.mapInArrow(run, schema), "packed"), capacity, open_bins)
