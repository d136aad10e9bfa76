"""Substring deduplication with difference-cover anchors.

A word is removed when a window of ``window`` consecutive words covers it whose word sequence
also starts in a document with a smaller id. Anchors find the candidates: the hash of a
shorter word run is kept at positions whose remainder modulo ``period`` lies in a difference
cover, a set in which every remainder is the difference of two members. Two places that share
``window`` words therefore share an aligned anchor inside them, whatever their positions, so
only documents with a shared anchor, and there only windows that contain one, are extended to
full 96-bit window hashes and compared.

Stages, each written to the shared folder:

1. ``profile``: per document the word count, a digest of its words, and its anchors. Documents
   with the same word sequence form a class; only one row with the smallest id goes on, under
   a key of its own, since all windows of the others are repeats.
2. Anchors that two documents share: a partial count per hash, then a semi-join back.
3. Windows around shared anchors, hashed over their whole length; the smallest id per hash is
   a partial minimum, joined back to the rows with a larger id.
4. Covered words per document, and the texts without them.

Texts travel compressed, and only those that stages 3 and 4 need. Hot passages cost one row a
document in the joins, which the adaptive skew join splits; no list of documents is gathered.

Defined results: a null text has no words; documents shorter than the window lose nothing;
rows that repeat an id (or have none) don't count as smaller than each other, and each text is
cut by its own windows; null ids are never smaller than another and lose what any document with
an id has.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import saved, word_array

#: Odd multipliers of the two rolling hashes, and the seeds of their word hashes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SEEDS = (11, 23)


def difference_cover(period: int) -> tuple[int, ...]:
    """A small set of remainders such that every remainder is a difference of two of them."""
    best: tuple[int, ...] = tuple(range(period))
    goal = (1 << period) - 1

    def grow(chosen, covered, start):
        nonlocal best
        if covered == goal:
            if len(chosen) < len(best):
                best = tuple(chosen)
            return
        open_diffs = bin(goal & ~covered).count("1")
        need, gained = 0, 0
        while gained < open_diffs:
            gained += 2 * (len(chosen) + need)
            need += 1
        if len(chosen) + need >= len(best) or len(best) * (len(best) - 1) + 1 <= period:
            return
        for x in range(start, period):
            more = covered
            for c in chosen:
                more |= 1 << (x - c) % period | 1 << (c - x) % period
            grow(chosen + [x], more, x + 1)

    grow([0, 1], 1 | 2 | 1 << (period - 1), 2)
    return best


def anchor_words(window: int, period: int) -> int:
    return window - period + 1


def _word_hashes(words, seed):
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def _powers(base: int, n: int):
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))


def rolling(hashes, width: int, which: int):
    """64-bit hash of every run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = _BASES[which]
    up = _powers(base, len(hashes) - 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up)))
    down = _powers(pow(base, -1, 1 << 64), n - 1)
    h = (sums[width:] - sums[:n]) * down
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _slices(batches, target=8 << 20):
    """Row groups of about ``target`` bytes of text, so that what is derived stays bounded."""
    for b in batches:
        start, size = 0, 0
        lengths = [0 if t is None else len(t) for t in (x.as_py() for x in b.column(1))] \
            if b.nbytes > target else None
        if lengths is None:
            yield b
            continue
        for i, n in enumerate(lengths):
            size += n
            if size >= target:
                yield b.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < b.num_rows:
            yield b.slice(start)


def _positions(n_words: int, width: int, period: int, cover) -> np.ndarray:
    """Anchor positions of a document, in order; the rank of an anchor is its place here."""
    at = np.arange(max(n_words - width + 1, 0))
    return at[np.isin(at % period, cover)]


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def words_digest(text: Column) -> Column:
    """The digest of a text's words, as ``changed`` of ``deduplicate`` has it (JVM-side)."""
    return F.sha2(F.array_join(word_array(F.coalesce(text, F.lit(""))), " "), 256)


def _profile(width, period, cover):
    def run(batches):
        for b in _slices(batches):
            n_words, digests, anchors = [], [], []
            for t in b.column(1).to_pylist():
                words = (t or "").encode().split()
                n_words.append(len(words))
                digests.append(_digest(words))
                at = _positions(len(words), width, period, cover)
                anchors.append(rolling(_word_hashes(words, _SEEDS[0]), width, 0)[at] if len(at)
                               else np.empty(0, np.uint64))
            offsets = np.concatenate(([0], np.cumsum([len(a) for a in anchors]))).astype(np.int32)
            flat = np.concatenate(anchors).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(digests, pa.string()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["id", "n_words", "digest", "anchors"])
    return run


def _packed(batches):
    """Texts compressed for the shuffle, with the digest of their words."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        texts = [(t or "").encode() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([_digest(t.split()) for t in texts], pa.string()),
             pa.array([z.compress(t) for t in texts], pa.binary())], names=["id", "digest", "packed"])


def _unpack(blob: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob).split()


def _windows(window, period, cover):
    """Hashes of the windows that contain a shared anchor."""
    width = anchor_words(window, period)

    def run(batches):
        for b in batches:
            for i, key, blob, shared in zip(*(c.to_pylist() for c in b.columns)):
                words = _unpack(blob)
                n = len(words) - window + 1
                at = _positions(len(words), width, period, cover)
                ranks = np.array(shared, np.int64)
                at = at[ranks[ranks < len(at)]]
                if n <= 0 or not len(at):
                    continue
                # such windows start in [at + width - window, at]
                steps = np.zeros(n + 1, np.int64)
                np.add.at(steps, np.clip(at + width - window, 0, n), 1)
                np.add.at(steps, np.clip(at + 1, 0, n), -1)
                starts = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
                h1, h2 = (rolling(_word_hashes(words, _SEEDS[k]), window, k)[starts] for k in (0, 1))
                # 32 bits of the second hash and the start in one long: narrow rows in the shuffles
                tail = h2.view(np.int64) << 32 | starts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(starts), i)), pa.array(np.full(len(starts), key)),
                     pa.array(h1.view(np.int64)), pa.array(tail)], names=["id", "key", "h1", "tail"])
    return _batched(run)


def _batched(run, rows=1 << 18):
    """Output batches of about ``rows`` rows out of many small ones."""
    def merged(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return merged


def _cut(window):
    """Documents without the words that the windows at ``starts`` cover."""
    def run(batches):
        for b in batches:
            removed, digests, texts = [], [], []
            for blob, starts in zip(*(c.to_pylist() for c in b.columns[2:])):
                words = _unpack(blob)
                steps = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.array(starts, np.int64))
                at = at[at + window <= len(words)]
                np.add.at(steps, at, 1)
                np.add.at(steps, at + window, -1)
                covered = np.cumsum(steps[:-1]) > 0
                kept = b" ".join([w for w, c in zip(words, covered.tolist()) if not c])
                removed.append(int(covered.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(texts, pa.binary()).cast(pa.string())],
                names=["id", "digest", "n_removed", "kept_sha256", "kept_text"])
    return run


#: Stands for a null id: after all others.
LAST = (1 << 63) - 1


def deduplicate(docs: DataFrame, key: str, text: str = "text", window: int = 50,
                period: int = 31) -> tuple[DataFrame, DataFrame]:
    """(report, changed).

    ``report`` has ``(id, n_words, n_removed, kept_sha256)`` for every row; ``changed`` has
    ``(id, digest, kept_text)`` once for each id and word sequence that loses words, where
    ``digest`` is that of ``words_digest`` and ``kept_text`` holds the words left, joined by one
    space. A null id is given as the largest long.
    """
    cover = np.array(difference_cover(period))
    width = anchor_words(window, period)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.col(text).alias("text"))
    prof = saved(rows.mapInArrow(_profile(width, period, cover),
                                 "id long, n_words long, digest string, anchors array<long>")
                 .withColumn("key", F.monotonically_increasing_id()), "anchors")
    # classes of equal word sequences: all but the smallest id repeat a smaller document whole
    first = prof.groupBy("digest").agg(F.min(F.struct("id", "key")).alias("first"))
    info = saved(prof.select("id", "key", "n_words", "digest").join(first, "digest")
                 .withColumn("copy", (F.col("id") > F.col("first.id")) & (F.col("n_words") >= window))
                 .withColumn("leads", F.col("key") == F.col("first.key"))
                 .drop("first"), "classes")
    # anchors that two rows share
    anchors = prof.select("key", F.posexplode("anchors").alias("rank", "hash"))
    shared = anchors.groupBy("hash").count().filter("count > 1").select("hash")
    nominated = (anchors.join(shared, "hash", "left_semi").groupBy("key")
                 .agg(F.collect_set("rank").alias("ranks"))
                 .join(info.filter("leads").select("key", "id", "digest"), "key"))
    packed = rows.mapInArrow(_packed, "id long, digest string, packed binary")
    candidates = saved(packed.join(nominated, ["id", "digest"]).dropDuplicates(["id", "digest"]), "candidates")
    # their windows, whole; the smallest id of each
    windows = saved(candidates.select("id", "key", "packed", "ranks").mapInArrow(
        _windows(window, period, cover), "id long, key long, h1 long, tail long"), "windows")
    h2 = F.shiftright("tail", 32)
    least = windows.groupBy(F.col("h1").alias("l1"), h2.alias("l2")).agg(F.min("id").alias("lo"))
    covered = (windows.join(least, (F.col("h1") == F.col("l1")) & (h2 == F.col("l2"))).filter("lo < id")
               .groupBy("key").agg(F.collect_list(F.col("tail").bitwiseAND(F.lit((1 << 32) - 1))).alias("starts")))
    cut = saved(candidates.select("key", "id", "digest", "packed").join(covered, "key")
                .select("id", "digest", "packed", "starts").mapInArrow(
        _cut(window), "id long, digest string, n_removed long, kept_sha256 string, kept_text string"), "cut")
    report = info.join(cut.drop("kept_text"), ["id", "digest"], "left").select(
        "id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
        .cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "digest"))
        .alias("kept_sha256"))
    copies = info.filter("copy").select("id", "digest", F.lit("").alias("kept_text")).distinct()
    return report, cut.select("id", "digest", "kept_text").unionByName(copies)
