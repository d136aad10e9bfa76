"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut into units that no piece can span: a run of spaces with what follows up to the
next space, and characters that stand in no piece of two or more. The different units of a
batch are laid out as flat numpy arrays of symbols. In every round each unit's smallest pair
rank is found by a segmented minimum, all its leftmost non-overlapping pairs of that rank are
merged at once, and the arrays are compacted; units without a pair are set aside, until none
has one. A rank whose merge can make room for a better one is merged one pair at a time, as
the library's queue would. A unit longer than ``LONG`` goes through such a queue as a whole, so
that its cost follows its length.

Defined results: a null text is the empty text and has no ids; text is taken as it is, so
control pieces spelled out in a text are ordinary characters; repeated rows are encoded each.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import per_worker

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_NONE = np.int64(1) << 40
LONG = 256  # symbols beyond which a unit is merged by a heap: rounds would pass over it too often


class Model:
    """Pieces, pair table and byte ids of a BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
                or not norm.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models without normalisation and with leading spaces are handled")
        if any(p.type == _USER for p in proto.pieces):
            raise ValueError("user-defined pieces are not handled")
        self.dummy_prefix = norm.add_dummy_prefix
        self.byte_fallback = trainer.byte_fallback
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.unk = self.types.index(_UNKNOWN)
        self.bytes = np.full(256, self.unk, np.int64)
        for i, p in enumerate(proto.pieces):
            if p.type == _BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        if any(SPACE in p[1:] and p.strip(SPACE) for p in normal):
            raise ValueError("a piece spans words")
        # symbols: every piece, then single characters outside the vocabulary as they turn up
        order = sorted(normal, key=lambda p: (-proto.pieces[normal[p]].score, normal[p]))
        by_score: dict[float, int] = {}
        rank = {p: by_score.setdefault(proto.pieces[normal[p]].score, len(by_score)) for p in order}
        singles = sorted({c for p in normal for c in p})
        names = list(normal) + [c for c in singles if c not in normal]
        self.symbol = {s: i for i, s in enumerate(names)}
        self.n = len(names)
        self.ids = np.array([normal.get(s, -1) for s in names], np.int64)
        self.names = names
        pairs = {}
        for p, r in rank.items():
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.n + b] = (r, self.symbol[p])
        self.pair = {(k // self.n, k % self.n): v for k, v in pairs.items()}
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.rank = np.array([pairs[k][0] for k in keys.tolist()] + [_NONE], np.int64)
        self.made = np.array([pairs[k][1] for k in keys.tolist()] + [0], np.int64)
        # ranks after which a better pair, or one as good, may appear beside the merged symbol
        self.careful = np.zeros(len(by_score) + 1, bool)
        for a, b, r in zip(keys // self.n, keys % self.n, self.rank[:-1]):
            for part in (int(a), int(b)):
                own = rank.get(names[part])
                if own is not None and r <= own:
                    self.careful[own] = True
        # scores that several pieces share are merged one at a time as well
        seen = np.bincount(np.fromiter(rank.values(), np.int64), minlength=len(self.careful))
        self.careful |= seen > 1
        # what a piece says whatever stands beside it; a byte of a longer character has no such text
        self.plain = [p.piece.replace(SPACE, " ") if p.type == _NORMAL else
                      chr(int(p.piece[1:-1], 16)) if p.type == _BYTE and int(p.piece[1:-1], 16) < 128 else None
                      for p in proto.pieces]
        self.in_pairs = {c for p in normal if len(p) > 1 for c in p}
        first = re.escape(SPACE)
        alone = "".join(re.escape(c) for c in sorted(self.in_pairs - {SPACE}))
        self.unit = re.compile(f"{first}+[{alone}]*|[{alone}]+|[^{alone}{first}]")

    def _pairs(self, symbols, unit, at):
        """(rank, merged symbol) of the pairs that begin at positions ``at``."""
        left, right = symbols[at], symbols[at + 1]
        key = left * self.n + right
        place = np.searchsorted(self.keys, key)
        hit = (left >= 0) & (right >= 0) & (unit[at] == unit[at + 1]) & (self.keys[place] == key)
        return np.where(hit, self.rank[place], _NONE), self.made[place]

    def merge(self, symbols: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (and the unit of each) when no pair is left; ``unit`` is ascending.

        Symbols below 0 stand for characters outside the vocabulary and merge with nothing.
        Ranks are kept from round to round; only pairs beside a merged symbol are looked up.
        """
        done = []
        rank, made = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            rank[:-1], made[:-1] = self._pairs(symbols, unit, np.arange(len(symbols) - 1))
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            low = np.minimum.reduceat(rank, starts)
            low = np.repeat(low, np.diff(np.append(starts, len(unit))))
            live = low < _NONE
            if not live.all():
                done.append((symbols[~live], unit[~live]))
            best = np.flatnonzero(live & (rank == low))
            if not len(best):
                break
            # in a chain of overlapping pairs every second one is taken, from the left
            gap = np.concatenate(([True], np.diff(best) > 1))
            chain = np.maximum.accumulate(np.where(gap, np.arange(len(best)), 0))
            take = (np.arange(len(best)) - chain) % 2 == 0
            one = self.careful[low[best]]
            leftmost = np.concatenate(([True], unit[best][1:] != unit[best][:-1]))
            best = best[take & (~one | leftmost)]
            symbols[best] = made[best]
            keep = live
            keep[best + 1] = False
            place = (np.cumsum(keep) - 1)[best]
            symbols, unit, rank, made = symbols[keep], unit[keep], rank[keep], made[keep]
            beside = np.concatenate((place, place[place > 0] - 1))
            rank[beside[beside == len(symbols) - 1]] = _NONE
            beside = beside[beside < len(symbols) - 1]
            rank[beside], made[beside] = self._pairs(symbols, unit, beside)
        if not done:
            return symbols, unit
        symbols, unit = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(unit, kind="stable")
        return symbols[order], unit[order]

    def merge_long(self, symbols: list[int]) -> list[int]:
        """A long unit's symbols when no pair is left, by a heap: smallest rank, leftmost first."""
        n, pair = len(symbols), self.pair
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pair[p][0], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in pair]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if j >= n or (symbols[i], symbols[j]) != p:
                continue
            symbols[i], symbols[j] = pair[p][1], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for at in (before[i], i):
                if at >= 0 and after[at] < n:
                    p = symbols[at], symbols[after[at]]
                    if p in pair:
                        heapq.heappush(heap, (pair[p][0], at, p))
        return [s for s in symbols if s is not None]

    def encode_units(self, units: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all units in a row, and where each unit's begin."""
        flat = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        chars, code = np.unique(flat, return_inverse=True)
        table = np.array([self.symbol.get(chr(c), -1 - int(c)) for c in chars], np.int64)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        symbols = table[code.reshape(-1)] if len(flat) else np.empty(0, np.int64)
        unit = np.repeat(np.arange(len(units)), lengths)
        long = lengths > LONG
        inside = long[unit] if len(unit) else np.empty(0, bool)
        first = np.cumsum(lengths) - lengths
        alone = [(i, self.merge_long(symbols[first[i]:first[i] + lengths[i]].tolist())) for i in np.flatnonzero(long).tolist()]
        symbols, unit = self.merge(symbols[~inside], unit[~inside])
        if alone:
            symbols = np.concatenate((symbols, *[np.array(s, np.int64) for _, s in alone]))
            unit = np.concatenate((unit, *[np.full(len(s), i) for i, s in alone]))
            order = np.argsort(unit, kind="stable")
            symbols, unit = symbols[order], unit[order]
        ids = np.where(symbols >= 0, self.ids[np.maximum(symbols, 0)], -1)
        bad = np.flatnonzero(ids < 0)
        if len(bad):
            spelled = [self._fallback(int(s)) for s in symbols[bad]]
            times = np.ones(len(ids), np.int64)
            times[bad] = [len(s) for s in spelled]
            ids, unit = np.repeat(ids, times), np.repeat(unit, times)
            ids[ids < 0] = np.concatenate(spelled)
        return ids, np.searchsorted(unit, np.arange(len(units) + 1))

    def _fallback(self, symbol: int) -> np.ndarray:
        char = self.names[symbol] if symbol >= 0 else chr(-1 - symbol)
        if self.byte_fallback:
            return self.bytes[np.frombuffer(char.encode("utf-8", "surrogatepass"), np.uint8)]
        return np.array([self.unk])

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", SPACE)
        return self.unit.findall(SPACE + text if self.dummy_prefix else text)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts; each different unit of the batch is encoded once."""
        cut = [self.units(t or "") for t in texts]
        flat = pa.array([u for c in cut for u in c], pa.string()).dictionary_encode()
        index = flat.indices.to_numpy()
        ids, at = self.encode_units(flat.dictionary.to_pylist())
        sizes = np.diff(at)[index]
        ends = np.cumsum(sizes)
        # position of every output id: its unit's first id plus its place in the unit
        source = np.repeat(at[index] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        doc_units = np.concatenate(([0], np.cumsum([len(c) for c in cut])))
        return ids[source], np.concatenate(([0], ends))[doc_units]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: byte pieces are gathered and read as UTF-8 (an invalid byte gives
        U+FFFD), control pieces give nothing, the leading space goes."""
        parts = [self.plain[i] for i in ids]
        if None not in parts:
            if self.dummy_prefix and parts and parts[0].startswith(" ") and self.types[ids[0]] == _NORMAL:
                parts[0] = parts[0][1:]
            return "".join(parts)
        out, held = [], bytearray()

        def flush():
            while held:
                try:
                    out.append(held.decode())
                    held.clear()
                except UnicodeDecodeError as e:
                    out.append(held[:e.start].decode() + "�")
                    del held[:e.start + 1]

        first = True
        for i in ids:
            if self.types[i] == _BYTE:
                held.append(int(self.pieces[i][1:-1], 16))
                first = False
                continue
            flush()
            if self.types[i] == _CONTROL:
                continue
            piece = " ⁇ " if self.types[i] == _UNKNOWN else self.pieces[i].replace(SPACE, " ")
            if first and self.dummy_prefix and piece.startswith(" ") and self.types[i] != _UNKNOWN:
                piece = piece[1:]
            out.append(piece)
            first = False
        flush()
        return "".join(out)


def _model(path: str) -> Model:
    return per_worker(f"piece {path}", lambda: Model(path))


def _batches(sizes, limit):
    """(first row, last row) of groups of about ``limit`` bytes."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


#: Bytes of text encoded together.
BATCH_BYTES = 1 << 20


def encode(docs: DataFrame, key: str, text: str, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``(id, ids)`` per row, for the model file at ``path``, which executors must reach."""
    def run(batches):
        model = _model(path)
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
            for lo, hi in _batches(sizes, batch_bytes):
                ids, at = model.encode(b.column(1).slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))],
                    names=["id", "ids"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` to rows with an array of ids."""
    def run(batches):
        model = _model(path)
        for b in batches:
            at = b.schema.get_field_index(ids)
            # ids become Python numbers one row at a time: as lists they take ten times the room
            texts = pa.array([model.decode(x.values.to_numpy().tolist()) if x.is_valid else None
                              for x in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, "decoded"])

    from pyspark.sql.types import StringType, StructType
    schema = StructType([*coded.schema.fields]).add("decoded", StringType())
    return coded.mapInArrow(run, schema)
