"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64-bit majorities over XXH64 hashes of word shingles. Two fingerprints with
at most ``max_bits`` differing bits are linked. The 64 bits are cut into segments; by the
pigeonhole principle some segment differs by no more than its radius, where the radii add up
to ``max_bits - segments + 1``. Every fingerprint stands in a table under each of its segment
values, probes the small Hamming balls around them, and what the probes fetch is verified
over all 64 bits.

Skew: equal fingerprints become one class before anything is compared, so exact copies never
meet. A segment value that more than ``hot_bucket`` different fingerprints share takes the
midpoint way instead of the table: fingerprints within 2r bits share a code within r bits of
both, and those around one code are all linked, so a star to the smallest per code links
them with rows in proportion to the members. It loses no link.

Defined results: a null text or one without words has fingerprint zero, which links like any
other; repeated rows are kept and fall into one class; components
are found over fingerprints, so rows that share an id but no text meet only by their texts; a null id is given as the largest
long, so it is the smallest of a class only if all are null.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import saved
from tidemark.llm.components import components

BITS = 64
LAST = (1 << 63) - 1
SEED = 42
_BLOCK = 1 << 17  # shingles expanded to bits at a time


def fingerprint(text: str | None, shingle: int = 4, seed: int = SEED) -> int:
    """Bit i is set when more than half of the shingle hashes, repeats included, set it."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both ASCII only on bytes
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - shingle + 1, 1)
    last = ends[min(shingle, len(words)) - 1:]
    h, digest = np.empty(n, ">u8"), xxhash.xxh64_intdigest
    h[:] = [digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())]
    total = np.zeros(BITS, np.int64)
    for i in range(0, n, _BLOCK):
        total += np.unpackbits(h[i:i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _fingerprints(shingle, seed):
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()],
                           np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps, pa.int64())],
                                             names=["id", "text_key", "fp"])
    return run


def fingerprints(docs: DataFrame, key: str, text: str = "text", shingle: int = 4,
                 seed: int = SEED) -> DataFrame:
    """``(id, text_key, fp)`` per row; ``fp`` holds the 64 bits as a signed long."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), text,
                       text_key(F.col(text))).mapInArrow(
        _fingerprints(shingle, seed), "id long, text_key binary, fp long")


def text_key(text: Column) -> Column:
    """128 bits that tell texts of one id apart; a null text is the empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("text_key")


def segments(count: int, max_bits: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of each segment; the radii add up to max_bits - count + 1."""
    cuts = [BITS * i // count for i in range(count + 1)]
    spare = max(max_bits - count + 1, 0)
    return [(lo, hi - lo, (spare + count - 1 - i) // count)
            for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]


def ball(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with at most ``radius`` set."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(width), r)]


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _around(value: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(_signed(m)) for m in masks]), lambda m: value.bitwiseXOR(m))


def links(classes: DataFrame, max_bits: int = 4, count: int = 3, hot_bucket: int = 1000) -> DataFrame:
    """``(fp, other)``: links that connect all of ``classes`` (distinct ``fp``) that lie within
    ``max_bits``: every linked pair outside the hot buckets, and stars for these."""
    segs = segments(count, max_bits)
    value = [F.shiftright("fp", lo).bitwiseAND(F.lit((1 << w) - 1)) for lo, w, _ in segs]
    tagged = [v.bitwiseOR(F.lit(_signed(i << 60))) for i, v in enumerate(value)]
    table = classes.select("fp", F.explode(F.array(*tagged)).alias("at"))
    hot = table.groupBy("at").count().filter(F.col("count") > hot_bucket).select("at")
    balls = [_around(t, ball(w, r)) for t, (_, w, r) in zip(tagged, segs)]
    probes = classes.select(F.col("fp").alias("other"), F.explode(F.concat(*balls)).alias("probe"))
    cool = table.join(hot, "at", "left_anti")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits
    pairs = (probes.join(cool, F.col("probe") == F.col("at"))
             .filter((F.col("fp") != F.col("other")) & near).select("fp", "other"))
    if max_bits < 1:
        return pairs
    # members of hot buckets, with those that probe them; an odd distance needs the larger half
    half = (max_bits + 1) // 2
    crowd = (probes.join(hot, F.col("probe") == F.col("at"), "left_semi").select(F.col("other").alias("fp"))
             .distinct())
    codes = crowd.select("fp", F.explode(_around(F.col("fp"), ball(BITS, half))).alias("code"))
    if max_bits % 2:  # within half bits of a code on both sides may be one bit too far
        return pairs.unionAll(_odd_links(codes, max_bits))
    first = codes.groupBy("code").agg(F.min("fp").alias("other"), F.count("*").alias("n")).filter("n > 1")
    stars = codes.join(first, "code").filter("fp <> other").select("fp", "other").distinct()
    return pairs.unionAll(stars)


def _odd_links(codes: DataFrame, max_bits: int) -> DataFrame:
    """For an odd limit: a code with members at most ``max_bits // 2`` away joins everyone
    around it to the smallest of these; both ends stay within the limit."""
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("code")))
    c = codes.withColumn("far", far)
    centre = c.filter(F.col("far") <= max_bits // 2).groupBy("code").agg(F.min("fp").alias("other"))
    return c.join(centre, "code").filter("fp <> other").select("fp", "other").distinct()


def near_duplicates(docs: DataFrame, key: str, text: str = "text", shingle: int = 4, max_bits: int = 4,
                    count: int = 3, hot_bucket: int = 1000) -> DataFrame:
    """``(id, text_key, fp, root, component)`` for every row; the component is the smallest id
    reachable. ``root`` names a component alone, also where ids are null or stand for several
    texts; ``text_key`` is the digest of the text."""
    fps = saved(fingerprints(docs, key, text, shingle), "fingerprints")
    classes = saved(fps.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    found = links(classes.select("fp"), max_bits, count, hot_bucket)
    comp = components(found.select(F.col("fp").alias("a"), F.col("other").alias("b")), "simhash")
    of_class = saved(classes.join(comp, F.col("fp") == F.col("id"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "fp").alias("root"), "rep"), "class-roots")
    least = saved(of_class.groupBy("root").agg(F.min("rep").alias("component")), "root-ids")
    of_class = saved(of_class.drop("rep").join(least, "root"), "class-components")
    return fps.join(of_class, F.col("fp") == F.col("_fp"), "left").drop("_fp")
