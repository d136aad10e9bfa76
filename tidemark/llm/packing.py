"""Best-fit decreasing packing of tokenised documents into fixed-length sequences.

1. Arrow functions tokenise whole texts, close each document with an end id, cut the longer
   ones and return one row per piece: where it starts, its length and a checksum of its ids.
2. The pieces (a few numbers each) are dealt evenly into shards of a bounded count. A shard is
   packed best fit, longest first: a segment tree over the remaining capacities finds the
   tightest open sequence in logarithmic time. Shards are large, so the one sequence that
   each may leave partly empty is all that is lost against packing everything together.

Texts and ids don't go through the shuffle; ``sequences`` joins them for those who want token
arrays.

Defined results: a null text is empty and gives its end id alone; repeated rows are packed
each; an empty table gives no piece.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import per_worker, saved

#: Pieces packed together in one task.
SHARD_PIECES = 1 << 17


class ByteBpe:
    """Ids of a byte-level BPE vocabulary, as its ``tokenizers`` file gives them.

    The fast encoder reads the same vocabulary as ranks; ``special`` strings inside texts
    become their ids, as the library does by default. What it can't take (a run of white
    space beyond its limit) goes to the library.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.json_path, self.library = json_path, None

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except Exception:  # noqa: BLE001 - the regex engine's own error types
            return np.array(self.by_library(text), np.uint32)

    def by_library(self, text: str) -> list[int]:
        from tokenizers import Tokenizer

        if self.library is None:
            self.library = Tokenizer.from_file(self.json_path)
        return self.library.encode(text, add_special_tokens=False).ids


def cut_points(n: int, size: int) -> list[int]:
    """Where the pieces of a document of ``n`` ids start: all are full but maybe the first."""
    if n <= size:
        return [0]
    first = n % size or size
    return [0, *range(first, n, size)]


def _pieces(make, size, end_id, with_ids):
    def run(batches):
        coder = per_worker(f"pieces {make}", lambda: ByteBpe(*make))
        end = np.array([end_id], np.uint32)
        for b in batches:
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = np.concatenate((coder.encode(t), end)) if t else end
                ids = ids.astype("<u4", copy=False)
                points = cut_points(len(ids), size)
                for k, (lo, hi) in enumerate(zip(points, [*points[1:], len(ids)])):
                    rows.append(i), piece.append(k), start.append(lo), length.append(hi - lo)
                    crc.append(zlib.crc32(ids[lo:hi].tobytes()))
                    if with_ids:
                        kept.append(ids[lo:hi].astype(np.int32))
            arrays = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                      *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def pieces(docs: DataFrame, key: str, text: str, json_path: str, ranks_path: str, pattern: str,
           special: dict[str, int], size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``(id, piece, start, length, ids_crc32)`` and the ids where asked."""
    schema = f"id {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        _pieces((json_path, ranks_path, pattern, special), size, end_id, with_ids),
        schema + (", ids array<int>" if with_ids else ""))


class Capacities:
    """Segment tree over the remaining capacities 0..size: which have an open sequence."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        self._add(capacity, 1)

    def take(self, least: int):
        """(capacity, sequence) of an open sequence with the smallest capacity >= least."""
        i, count = least + self.leaves, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until a right sibling has one
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:  # down, to the leftmost
                i *= 2
                if not count[i]:
                    i += 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece; ties in length keep their order."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = Capacities(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            found, used = (size, used), used + 1
        capacity, sequence[i] = found
        offset[i] = size - capacity
        if capacity > n:
            tree.put(capacity - n, int(sequence[i]))
    return sequence, offset


def _pack(size):
    def run(batches):
        whole = pa.Table.from_batches(list(batches))
        if not whole.num_rows:
            return
        lengths = whole.column("length").to_numpy()
        sequence, offset = best_fit_decreasing(lengths, size)
        shard = whole.column("shard")[0].as_py()
        out = whole.drop_columns(["shard"]).append_column(
            "sequence_id", pa.array((shard << 40) + sequence)).append_column("offset", pa.array(offset))
        yield from out.combine_chunks().to_batches()
    return run


def pack(cut: DataFrame, size: int = 2048, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``cut`` (a materialised table of pieces) with ``sequence_id`` and ``offset``.

    The pieces are dealt evenly, whatever their ids, so no document or source makes a large
    shard, and the number of shards grows with the number of pieces.
    """
    shards = max(1, -(-cut.count() // shard_pieces))
    dealt = cut.repartition(shards).withColumn("shard", F.spark_partition_id())
    schema = ", ".join(f"{c} {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"
    return dealt.mapInArrow(_pack(size), schema)


def pack_documents(docs: DataFrame, key: str, text: str, json_path: str, ranks_path: str, pattern: str,
                   special: dict[str, int], size: int = 2048, end_id: int = 0,
                   shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Every piece of every document with its place."""
    cut = saved(pieces(docs, key, text, json_path, ranks_path, pattern, special, size, end_id), "pieces")
    return saved(pack(cut, size, shard_pieces), "packed")


def sequences(placed: DataFrame, with_ids: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the token array of every sequence, at most one sequence a group.

    ``with_ids`` is ``pieces(..., with_ids=True)`` of the same documents.
    """
    parts = placed.select("id", "piece", "sequence_id", "offset").join(
        with_ids.select("id", "piece", "ids"), ["id", "piece"])
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
