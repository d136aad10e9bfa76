"""BPE encoding by forced boundaries, and decoding.

A merge makes a vocabulary token, so a pair of neighbouring bytes that stands inside no token
is never merged across: it is a certain cut. Words are cut there, the different fragments of a
batch are encoded on their own, and their ids are put in a row. Whether a pair ends its word is
part of the pair, since the last byte carries the end-of-word mark and is a symbol of its own.
Fragments are laid out in flat arrays and merged in rounds, the smallest rank of each at a time;
a fragment too long for that goes through a heap, so a long run without a cut costs little more
than its length.

Stretches between ASCII white space are normalised and cut into words once each: a vocabulary is
refused unless white space separates words and is dropped. The library does that, but for
stretches of characters below U+0250 where the file asks for the usual steps: those characters
are their own normal form, and what they are and their lower case are the same in every version
of Unicode, so the file's own pattern finds the same words at a fraction of the cost.

Defined results: a null text is the empty text and has no ids; strings of special tokens inside
a text become those tokens, as the library does by default; repeated rows are encoded each;
null ids decode to null, ids outside the vocabulary to nothing.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import SPACES, per_worker
from tidemark.llm.tokens import split_safely

#: Bytes of text encoded together, and bytes of words whose ids a worker keeps.
BATCH_BYTES = 4 << 20
KNOWN_BYTES = 64 << 20
_INNER, _LAST, _SPECIAL = b"\0", b"\1", b"\2"
_SHORT = 48     # bytes up to which fragments are merged in rounds
_PLAIN = "\u0250"  # characters below it are their own normal form
_NONE = np.int64(1) << 40


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return [rest.get(b) or chr(b) for b in range(256)]


def _usual_pattern(spec: dict) -> str | None:
    """The pattern of words, if a text is but composed, its white space made one space, lowered,
    and cut by it; else none."""
    steps = [dict(n) for n in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if steps != [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}] \
            or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or cuts[1]["use_regex"] or cuts[1]["add_prefix_space"] \
            or cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"]:
        return None
    return cuts[0]["pattern"].get("Regex")


class Coder:
    """Tokens, merges and certain cuts of a byte-level BPE vocabulary file."""

    def __init__(self, path: str, known_bytes: int = KNOWN_BYTES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on every core already
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) \
                or spec["decoder"] is not None or any(
                    t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or set(t["content"]) & set(SPACES)
                    for t in spec["added_tokens"]):
            raise ValueError("only plain BPE vocabularies without a decoder are handled")
        whole = library.encode(f"a{SPACES}b{SPACES}", add_special_tokens=False).ids
        if whole != [i for w in "ab" for i in library.encode(w, add_special_tokens=False).ids]:
            raise ValueError("white space is part of tokens")
        self.normalize = library.normalizer.normalize_str if library.normalizer else str
        self.words = library.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        found = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.find_special = re.compile(f"({found})") if found else None
        self.maybe_special = re.compile(found).search if found else lambda text: None
        pattern = _usual_pattern(spec)
        self.find_words = regex.compile(pattern).findall if pattern else None
        chars = byte_characters()
        self.to_byte = {ord(c): b for b, c in enumerate(chars)}
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        try:
            self.byte_ids = [vocab[c] for c in chars]
            self.end_ids = [vocab[c + end] for c in chars]
        except KeyError as missing:
            raise ValueError("a byte has no token") from missing
        # pairs inside tokens: [0] amid a word, [1] at its end
        self.inside = np.zeros((2, 1 << 16), bool)
        for s in vocab:
            last = bool(end) and s.endswith(end)
            b = np.frombuffer(s[:len(s) - len(end) if last else None].translate(self.to_byte).encode("latin-1"), np.uint8)
            pairs = b[:-1].astype(np.int64) * 256 + b[1:]
            self.inside[0][pairs[:-1] if last else pairs] = True
            if len(pairs) and (last or not end):
                self.inside[1][pairs[-1]] = True
        self.merges = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        # merges as sorted arrays, for rounds: a token has one merge, ranked after its parts'
        self.n = max(vocab.values()) + 1
        made = {new: rank for rank, new in self.merges.values()}
        if len(made) < len(self.merges) or any(
                max(made.get(a, -1), made.get(b, -1)) > rank for (a, b), (rank, _) in self.merges.items()):
            raise ValueError("a merge comes before its parts")
        order = sorted(self.merges)
        self.keys = np.array([a * self.n + b for a, b in order] + [np.iinfo(np.int64).max], np.int64)
        self.ranks = np.array([self.merges[k][0] for k in order] + [_NONE], np.int64)
        self.made = np.array([self.merges[k][1] for k in order] + [0], np.int64)
        self.byte_table = np.array([self.byte_ids, self.end_ids], np.int64)
        self.known_bytes = known_bytes
        self._forget()

    # --- fragments ---
    def _pairs(self, symbols, unit, at):
        """(rank, merged symbol) of the pairs that begin at positions ``at``."""
        key = symbols[at] * self.n + symbols[at + 1]
        place = np.searchsorted(self.keys, key)
        hit = (unit[at] == unit[at + 1]) & (self.keys[place] == key)
        return np.where(hit, self.ranks[place], _NONE), self.made[place]

    def merge(self, symbols: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, unit of each) when nothing merges any more; ``unit`` is ascending.

        A round merges all pairs of each unit's smallest rank, from the left; that is what
        one merge after the other gives, since every new pair ranks after the one that made it.
        Only pairs beside a merged symbol are looked up again.
        """
        done = []
        rank, new = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            rank[:-1], new[:-1] = self._pairs(symbols, unit, np.arange(len(symbols) - 1))
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(unit))))
            live = low < _NONE
            done.append((symbols[~live], unit[~live]))
            best = np.flatnonzero(live & (rank == low))
            if not len(best):
                break
            # in a chain of overlapping pairs every second one is taken, from the left
            gap = np.concatenate(([True], np.diff(best) > 1))
            first = np.maximum.accumulate(np.where(gap, np.arange(len(best)), 0))
            best = best[(np.arange(len(best)) - first) % 2 == 0]
            symbols[best] = new[best]
            live[best + 1] = False
            at = (np.cumsum(live) - 1)[best]
            symbols, unit, rank, new = symbols[live], unit[live], rank[live], new[live]
            at = np.concatenate((at, at[at > 0] - 1))
            rank[at[at == len(symbols) - 1]] = _NONE
            at = at[at < len(symbols) - 1]
            rank[at], new[at] = self._pairs(symbols, unit, at)
        symbols, unit = (np.concatenate(x) for x in zip(*done)) if done else (symbols, unit)
        order = np.argsort(unit, kind="stable")
        return symbols[order], unit[order]

    def merge_long(self, ids: list[int]) -> list[int]:
        """``ids`` after all merges, smallest rank first, leftmost of equals, by a heap."""
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if (m := get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.merges[pair][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for at in (before[i], i):
                if at >= 0 and after[at] < n:
                    p = ids[at], ids[after[at]]
                    if (m := get(p)) is not None:
                        heapq.heappush(heap, (m[0], at, p))
        return [i for i in ids if i >= 0]

    def encode_fragments(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of fragments as :meth:`cut` gives them."""
        short = [i for i, k in enumerate(keys) if len(k) <= _SHORT and k[-1:] != _SPECIAL]
        data = np.frombuffer(b"".join(keys[i] for i in short), np.uint8)
        sizes = np.fromiter((len(keys[i]) for i in short), np.int64, len(short))
        ends = np.cumsum(sizes) - 1  # where each key's mark stands
        last = np.zeros(len(data), np.int64)
        last[ends - 1] = data[ends]
        text = np.ones(len(data), bool)
        text[ends] = False
        ids, unit = self.merge(self.byte_table[last[text], data[text]], np.repeat(np.array(short, np.int64), sizes - 1))
        for i in sorted(set(range(len(keys))) - set(short)):
            key, kind = keys[i][:-1], keys[i][-1:]
            own = [self.special[key.decode()]] if kind == _SPECIAL else self.merge_long(
                [self.byte_ids[b] for b in key[:-1]] + [(self.end_ids if kind == _LAST else self.byte_ids)[key[-1]]])
            ids, unit = np.append(ids, own), np.append(unit, [i] * len(own))
        order = np.argsort(unit, kind="stable")
        return ids[order].astype(np.int32), np.bincount(unit.astype(np.int64), minlength=len(keys))

    # --- words ---
    def _pieces(self, words: list[str]):
        """(bytes, whether a special token, word number) of the parts that the library cuts
        words into."""
        for i, w in enumerate(words):
            if w and max(w) < _PLAIN and self.find_words and w.split() == [w] and not self.maybe_special(w):
                for p in self.find_words(w.lower()):
                    yield p.encode(), False, i
                continue
            for k, part in enumerate(self.find_special.split(w) if self.find_special else [w]):
                if k % 2:
                    yield part.encode(), True, i
                elif part:
                    for p, _ in self.words(self.normalize(part)):
                        yield p.translate(self.to_byte).encode("latin-1"), False, i

    def cut(self, pieces: list[bytes], special: Sequence[bool]) -> tuple[list[bytes], np.ndarray]:
        """Fragments of the pieces, as keys, and the piece of each."""
        data = b"".join(pieces)
        buf = np.frombuffer(data, np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        cut = np.ones(len(buf), bool)
        if len(buf) > 1:
            last = np.zeros(len(buf), np.int64)
            last[ends - 1] = 1
            cut[1:] = ~self.inside[last[1:], buf[:-1] * 256 + buf[1:]]
            cut[np.repeat(np.asarray(special, bool), sizes)] = False
            cut[ends - sizes] = True
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], len(buf))
        piece = np.searchsorted(ends, starts, side="right")
        kind = np.where(np.asarray(special, bool)[piece], 2, (stops == ends[piece]).astype(int)) if len(starts) else []
        mark = (_INNER, _LAST, _SPECIAL)
        return [data[a:b] + mark[k] for a, b, k in zip(starts.tolist(), stops.tolist(), list(kind))], piece

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of stretches without ASCII white space."""
        found = list(self._pieces(words))
        if not found:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        pieces, special, owner = zip(*found)
        keys, piece = self.cut(pieces, special)
        number: dict[bytes, int] = {}
        which = np.fromiter((number.setdefault(k, len(number)) for k in keys), np.int64, len(keys))
        ids, sizes = self.encode_fragments(list(number))
        ids, ends = _gather(ids, np.concatenate(([0], np.cumsum(sizes))), which)
        return ids, np.bincount(np.asarray(owner)[piece], np.diff(ends), len(words)).astype(np.int64)

    def _forget(self):
        self.slots, self.pool, self.at, self.kept_bytes = {}, np.empty(0, np.int32), np.zeros(1, np.int64), 0

    def _learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.slots]
        if new and self.kept_bytes + sum(map(len, new)) + 200 * len(new) > self.known_bytes:
            self._forget()
            new = words
        if new:
            ids, sizes = self.encode_words(new)
            self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new))))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(sizes)))
            self.pool = np.concatenate((self.pool, ids))
            self.kept_bytes += sum(map(len, new)) + 200 * len(new) + 4 * len(ids)

    # --- texts ---
    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts; each different stretch is encoded once."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn(words)
        slot = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()] \
            if words else np.empty(0, np.int64)
        ids, ends = _gather(self.pool, self.at, slot)
        return ids, ends[split.offsets.to_numpy()]

    def encode_long(self, text: str, limit: int) -> np.ndarray:
        """Ids of one text, encoded in parts cut at white space."""
        return np.concatenate([self.encode([part])[0] for part in split_safely(text, limit)])


def _gather(pool: np.ndarray, at: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): the stretches ``pool[at[s]:at[s + 1]]`` of all ``slots`` in a row."""
    sizes = at[slots + 1] - at[slots]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return pool[np.repeat(at[slots] - ends[:-1], sizes) + np.arange(ends[-1])], ends


class Names:
    """The text of each id of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["decoder"] is not None:
            raise ValueError("only vocabularies without a decoder are handled")
        by_id = {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.tokens = pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.string())
        self.known = pc.is_valid(self.tokens).to_numpy(zero_copy_only=False)

    def decode(self, ids: list[bytes | None]) -> pa.Array:
        """Texts of packed ids: the tokens with a space between them, as a vocabulary without a
        decoder reads."""
        flat = np.frombuffer(b"".join(i or b"" for i in ids), "<u4").astype(np.int64)
        good = flat < len(self.known)
        good[good] = self.known[flat[good]]
        sizes = np.fromiter((len(i or b"") // 4 for i in ids), np.int64, len(ids))
        at = np.concatenate(([0], np.cumsum(good)))[np.concatenate(([0], np.cumsum(sizes)))]
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), self.tokens.take(pa.array(flat[good])))
        return pc.if_else(pa.array([i is not None for i in ids]), pc.binary_join(lists, " "), pa.scalar(None, pa.string()))


def _coder(path: str) -> Coder:
    return per_worker(f"byte pairs {path}", lambda: Coder(path))


def _batches(sizes, limit):
    """(first row, last row) of runs of about ``limit`` bytes."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, key: str, text: str, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``(id, ids)`` per row, for the vocabulary file at ``path``, which executors must reach.

    ``ids`` are packed as little-endian unsigned 32-bit integers, as a token file holds them.
    """
    def run(batches):
        coder = _coder(path)
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
            for lo, hi in _batches(sizes, batch_bytes):
                texts = [t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                if len(texts) == 1:
                    packed = [coder.encode_long(texts[0], batch_bytes).astype("<u4").tobytes()]
                else:
                    ids, at = coder.encode(texts)
                    data, at = ids.astype("<u4").tobytes(), (4 * at).tolist()
                    packed = [data[i:j] for i, j in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(packed, pa.binary())],
                                                 names=["id", "ids"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {docs.schema[key].dataType.simpleString()}, ids binary")


def decode(coded: DataFrame, path: str, ids: str = "ids", out: str = "decoded", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Adds the text of each row's packed ids, in batches of about ``batch_bytes`` bytes of ids."""
    def run(batches):
        names = per_worker(f"token names {path}", lambda: Names(path))
        for b in batches:
            at = b.schema.get_field_index(ids)
            sizes = pc.fill_null(pc.binary_length(b.column(at)), 0).to_pylist()
            for lo, hi in _batches(sizes, batch_bytes):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, names.decode(part.column(at).to_pylist())],
                                                 names=[*part.schema.names, out])

    from pyspark.sql.types import StringType, StructType
    return coded.mapInArrow(run, StructType([*coded.schema.fields]).add(out, StringType()))
