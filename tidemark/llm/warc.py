"""WARC archives and their globally ordered capture index.

Writing. Records are text columns; a task compresses each into a gzip member of its own and
Spark's text writer puts the members in a row, so archives go to any file system Spark can
reach and any record can be read by its offset and length alone. The byte that the writer adds
after a row is the last byte of a member: the high byte of a length below 16 MiB, zero. Longer
records are several members. Payloads that are equal are stored once: of each group the record
with the largest id is the response, the others are revisit records that refer to it. Groups
are found from digests by a partial maximum; payloads move once, dealt by id.

Reading. Archives are read whole (their size is bounded when written), a member at a time, and
parsed by Content-Length, so payloads may hold anything, record separators included.

Index. Each archive gives a run of index rows sorted by (URL key, timestamp, id), written as a
table. Runs are cut into blocks and dealt to key ranges. Within a range Spark's sort, which
spills, brings the blocks in the order of their first keys, and a loser tree merges them: a slot
whose block ends takes the next block, and slots are added only while the next block begins below
the lowest row held. So a task holds no more than two blocks a run, whatever the range holds.
Ranges follow each other, so the histories of all captures are in one global order. A URL that
many captures share spans several ranges, as the timestamp and id belong to the key.

Defined results: a null html is an empty payload; a null URL is archived under
``urn:page:<id>`` and line breaks and spaces in one are percent-encoded; rows with a null id
are responses and come back with a null id; repeated rows are records each, and those that
repeat the largest id of a group are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from itertools import chain
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import saved
from tidemark.session import scratch_path

_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes in an archive; a record larger than that has an archive to itself, or nearly.
ARCHIVE_BYTES = 16 << 20
#: Bytes of a record in a gzip member: lengths below 2 ** 24 end in a zero byte.
MEMBER_BYTES = (1 << 24) - 1
#: Index rows in a block of a run.
BLOCK = 64


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a column, 20 bits at a time."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_uuid(key: Column) -> Column:
    h = F.md5(F.concat(F.lit("capture "), key.cast("string")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3),
                    F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def plan_revisits(captures: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(id, refers_to)`` of the captures (id, url, ts, payload) that are revisits.

    Groups are formed on (digest, length) alone, so a payload that a third of all rows share
    costs one row a task in the aggregation and narrow rows in the join back.
    """
    keys = captures.select("id", base32_sha1(F.col("payload")).alias("digest"),
                           F.octet_length("payload").cast("long").alias("bytes"))
    best = (keys.filter(F.col("bytes") >= min_bytes).groupBy("digest", "bytes")
            .agg(F.max("id").alias("best"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    return (keys.join(best, ["digest", "bytes"]).filter("id < best")
            .select("id", F.col("best").alias("refers_to")).distinct())


def record_text(c: DataFrame) -> DataFrame:
    """One text column: the record without the blank lines that end it."""
    revisit = F.col("refers_to").isNotNull()
    url = F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    for raw, code in ((" ", "%20"), ("\r", "%0D"), ("\n", "%0A"), ("\t", "%09")):
        url = F.replace(url, F.lit(raw), F.lit(code))
    block = F.concat(F.lit(_HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_uuid(F.coalesce(F.col("id").cast("string"), F.lit("null")))),
        line("WARC-Date", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)),
                                 line("WARC-Refers-To", record_uuid(F.col("refers_to").cast("string"))),
                                 line("X-Refers-To-Capture", F.col("refers_to").cast("string"))))
        .otherwise(F.lit("")),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(F.col("id").isNotNull(), line("X-Capture-ID", F.col("id").cast("string"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    return c.select(F.concat(head, block).alias("value"))


def compressed(record: bytes, limit: int = MEMBER_BYTES) -> bytes:
    """``record`` as gzip members of at most ``limit`` bytes each, without the zero that ends the last."""
    out = []
    for at in range(0, len(record), limit):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += [z.compress(record[at:at + limit]), z.flush()]
    return b"".join(out)[:-1]


def _compress(batches):
    end = _END.encode()
    for b in batches:
        packed = [compressed(v.as_py() + end) for v in b.column(0).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["value"])


def write(captures: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of all captures under ``path``, each of about ``archive_bytes`` before compression.

    Captures are dealt to archives by a hash of their id, once, which the join with the plan
    uses too; no host or copied page makes a large archive.
    """
    total = captures.agg(F.sum(F.octet_length("payload") + 600)).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))
    revisits = plan_revisits(captures, min_bytes).repartition(archives, "id").hint("shuffle_hash")
    dealt = captures.repartition(archives, "id").join(revisits, "id", "left").withColumns({
        "digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("long")})
    members = record_text(dealt).mapInArrow(_compress, "value binary")
    # the writer copies the bytes of a string as they are
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").text(path)


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels reversed, lower case, then path and query."""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").rstrip(".")
        port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
    except ValueError:
        return url
    if not host:
        return url
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + port + ")" + (u.path or "/").lower() + (f"?{u.query}" if u.query else "")


def members(data: bytes, chunk: int = 1 << 16):
    """(start, end, content) of the gzip members of an archive."""
    start = 0
    while start < len(data):
        z, at, content = zlib.decompressobj(31), start, []
        while not z.eof:
            part = data[at:at + chunk]
            if not part:
                raise ValueError(f"member at byte {start} is cut short")
            content.append(z.decompress(part))
            at += len(part)
        end = at - len(z.unused_data)
        yield start, end, b"".join(content)
        start = end


def _head(data: bytes):
    """(headers, where the block begins, bytes of the record), or None while the head isn't whole."""
    if not data.startswith(b"WARC/"):
        raise ValueError("no record")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    head = dict(x.split(": ", 1) for x in data[:end].decode().split("\r\n")[1:])
    return head, end + 4, end + 8 + int(head["Content-Length"])


def record(data: bytes):
    """(headers, block) of a record's bytes."""
    head, start, size = _head(data) or ({}, 0, -1)
    if len(data) != size or not data.endswith(b"\r\n\r\n"):
        raise ValueError("a record doesn't have the length it states")
    return head, data[start:-4]


def parse(data: bytes):
    """(offset, length, headers, block) of the records of an archive."""
    first, held, size, whole = 0, [], 0, None
    for start, end, content in members(data):
        if not held:
            first = start
        held.append(content)
        size += len(content)
        if whole is None:
            found = _head(content if len(held) == 1 else b"".join(held))
            whole = found and found[2]
        if whole is not None and size >= whole:
            yield first, end - first, *record(b"".join(held))
            held, size, whole = [], 0, None
    if held:
        raise ValueError(f"record at byte {first} is cut short")


INDEX = ("urlkey string, ts string, id long, url string, record_type string, refers_to long, "
         "payload_bytes long, payload_digest string, archive string, offset long, length long, run long, seq long")
#: A run's rows also carry the first key of their block.
RUNS = INDEX + ", front_key string, front_ts string, front_id long"
_TYPES = {"string": pa.string(), "long": pa.int64()}


def _arrow(columns: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in columns.split(", ")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _key(urlkey, ts, id_, run, seq):
    """Nulls come first, as Spark sorts them."""
    return urlkey, ts, id_ is not None, id_ or 0, run, seq


def _order(row):
    return _key(*row[:3], *row[11:13])


def _run(path: str, data: bytes, block_rows: int) -> list[tuple]:
    """The sorted index rows of one archive; digests are those of the payloads read."""
    run = int.from_bytes(hashlib.md5(path.encode()).digest()[:8], "big") >> 1
    rows = []
    for at, length, head, block in parse(data):
        payload = block[block.index(b"\r\n\r\n") + 4:]
        number = lambda name: int(head[name]) if name in head else None
        if head["WARC-Type"] == "response":
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if head["WARC-Payload-Digest"] != f"sha1:{digest}" or len(payload) != number("X-Payload-Length"):
                raise ValueError(f"{path}: payload at byte {at} doesn't match its digest")
        rows.append((url_key(head["WARC-Target-URI"]), head["WARC-Date"], number("X-Capture-ID"),
                     head["WARC-Target-URI"], head["WARC-Type"], number("X-Refers-To-Capture"),
                     number("X-Payload-Length"), head["WARC-Payload-Digest"].removeprefix("sha1:"),
                     path.rsplit("/", 1)[-1], at, length, run, at))
    rows.sort(key=_order)
    return [r[:12] + (i,) + rows[i // block_rows * block_rows][:3] for i, r in enumerate(rows)]


def _runs(block_rows: int):
    schema = _arrow(RUNS)

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0), b.column(1)):
                yield _batch(_run(path.as_py(), data.as_py(), block_rows), schema)
    return run


def read_runs(spark: SparkSession, path: str, block_rows: int = BLOCK) -> DataFrame:
    """Index rows of every archive under ``path``: one sorted run each (``run``, ``seq``)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(_runs(block_rows), RUNS)


class LoserTree:
    """k-way merge of sorted iterators: the winner leaves, and only the path of its leaf is
    played again against the losers kept there."""

    def __init__(self, runs, order):
        self.runs, self.order = [iter(r) for r in runs], order
        k = self.k = len(self.runs)
        self.head = [self._next(i) for i in range(k)]
        self.loser = [-1] * max(k, 1)
        for i in range(k):
            self._play(i)

    def _next(self, i):
        row = next(self.runs[i], None)
        return None if row is None else (self.order(row), i, row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _play(self, i: int) -> None:
        """Leaf ``i`` goes up; at a node it meets the loser there, at an empty one it waits."""
        node = (i + self.k) // 2
        while node:
            if self.loser[node] < 0:
                self.loser[node] = i
                return
            if self._beats(self.loser[node], i):
                self.loser[node], i = i, self.loser[node]
            node //= 2
        self.loser[0] = i

    def lowest(self):
        """The order of the row that leaves next, or None."""
        won = self.head[self.loser[0]] if self.k else None
        return won and won[0]

    def pop(self):
        i = self.loser[0]
        row = self.head[i][2]
        self.head[i] = self._next(i)
        self._play(i)
        return row

    def wider(self, runs) -> LoserTree:
        """A tree of this one's runs as they stand, and more."""
        rest = [chain([] if h is None else [h[2]], r) for h, r in zip(self.head, self.runs)]
        return LoserTree([*rest, *runs], self.order)

    def __iter__(self):
        while self.lowest() is not None:
            yield self.pop()


def merge_blocks(blocks, order, ways: int = 16):
    """The rows of sorted blocks in one order. ``blocks`` gives (front, rows) by front, which no row
    of the block is below.

    A row leaves once no unread block can hold a lower one. Slots are doubled, so the tree is built
    anew a few times only, and at most twice as many blocks are held as overlap somewhere.
    """
    blocks = iter(blocks)
    ahead = next(blocks, None)

    def slot():
        nonlocal ahead
        while ahead is not None:
            rows = ahead[1]
            ahead = next(blocks, None)
            yield from rows

    tree = LoserTree([slot() for _ in range(ways)], order)
    while tree.lowest() is not None:
        while ahead is not None and ahead[0] < tree.lowest():
            tree = tree.wider([slot() for _ in range(tree.k)])
        yield tree.pop()


def _blocks(batches, block_rows: int):
    """(front, rows) of the blocks in rows that come block by block."""
    at, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            front = _key(*row[13:16], row[11], row[12] // block_rows * block_rows)
            if front != at and rows:
                yield at, rows
                rows = []
            at = front
            rows.append(row[:13])
    if rows:
        yield at, rows


def _merge(block_rows: int, ways: int):
    schema = _arrow(INDEX)

    def run(batches):
        out = []
        for row in merge_blocks(_blocks(batches, block_rows), _order, ways):
            out.append(row)
            if len(out) == 1 << 14:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)
    return run


def merge_index(runs: DataFrame, block_rows: int = BLOCK, ways: int = 16) -> DataFrame:
    """All runs (a materialised table, with the same ``block_rows``) merged into one order over key
    ranges.

    Partitions follow each other in (urlkey, ts, id), and so do the rows in each.
    """
    ranges = runs.repartitionByRange("urlkey", "ts", "id", "run", "seq").sortWithinPartitions(
        "front_key", "front_ts", "front_id", "run", "seq")
    return ranges.mapInArrow(_merge(block_rows, ways), INDEX)


def archive_and_index(captures: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES,
                      path: str | None = None) -> DataFrame:
    """Writes ``captures`` (id, url, ts, payload) and returns the merged index of what was written."""
    spark = captures.sparkSession
    path = path or scratch_path(spark, "archives")
    write(captures, path, min_bytes, archive_bytes)
    return merge_index(saved(read_runs(spark, path), "runs"))
