"""Repair of conversation structure by Four-Russians block tables.

A conversation's rows, in order, are a string of symbols: the role's initial and the row's
fault. The cheapest edits that make the roles read ``(s?(ua)+)?`` follow from the cost to go
from each of four states (start, after s, after u, after a) at each place. Less its smallest
entry, such a vector is one of a few dozen, so for every vector and every block of ``BLOCK``
symbols the vector before the block is tabulated once. A conversation is read from its end a
block at a time by lookup; the edits are then traced from its start, each block's vectors being
expanded from the one behind it, taking the least letter wherever several edits are cheapest.

On Spark: the symbols are made from narrow rows (no text). Equal rows of a turn are one row
with a count, duplicates come from a partial minimum per (conversation, role, text digest), and
the rows are ordered by range, so a conversation of any size is cut over many tasks and ends as
pieces of one byte a row. What one task must hold of a conversation is what its result holds, a
letter a row. The digest of the repaired text is one SHA-256 over all of it, so one task streams
a conversation's texts, in order, batch by batch; it never holds them.

Defined results: null ids, turns, roles and texts count as one space where text is made of them;
a null id is a conversation of its own; null turns come first. Rows of one turn are ordered by
role, then by the text's digest. A role counts by its first character, an empty role by none,
which can't be kept. A conversation without rows has zeros and empty results; ``gaps`` beyond a
long is null.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import SPACES, per_worker, saved

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 3
#: A symbol is 4 * initial + fault, as a letter from "A"; faults in the order they are judged.
INITIALS, FAULTS = "sua", ("clean", "blank", "duplicate", "truncated")

_START, _S, _U, _A = range(4)
_EMITS = {_START: "u", _S: "u", _U: "a", _A: "u"}  # the initial that an insertion or a new role gives
_NEXT = {(_START, "s"): _S, (_START, "u"): _U, (_S, "u"): _U, (_U, "a"): _A, (_A, "u"): _U}
_ROLE = {"u": "user", "a": "assistant"}
_FAR = 1 << 40


def _inserted(cost: list[int]) -> list[int]:
    """Costs to go when edits may begin with insertions."""
    for _ in range(4):
        cost = [min(c, INSERT + cost[_NEXT[q, _EMITS[q]]]) for q, c in enumerate(cost)]
    return cost


END = _inserted([0, _FAR, _FAR, 0])


def _class(symbol: int) -> int:
    """Symbols that cost alike: 0 must go; else 1 + 2 * initial + truncated."""
    initial, fault = divmod(symbol, 4)
    return 0 if fault in (1, 2) else 1 + 2 * initial + (fault == 3)


CLASSES = 9


def _before(kind: int, after: list[int]) -> list[int]:
    """Costs to go before a row of class ``kind``."""
    cost = []
    for q in range(4):
        best = DELETE + after[q]
        if kind:
            initial, cut = divmod(kind - 1, 2)
            to = _NEXT.get((q, (INITIALS + "?")[initial]))
            best = min(best, REROLE + TRUNCATED * cut + after[_NEXT[q, _EMITS[q]]],
                       _FAR if to is None else KEEP + TRUNCATED * cut + after[to])
        cost.append(best)
    return _inserted(cost)


class Tables:
    """Normalised vectors that can occur, and what a block does to each of them."""

    def __init__(self, block: int = BLOCK):
        self.block, self.vectors, at = block, [], {}

        def number(cost):
            low = min(cost)
            v = tuple(c - low for c in cost)
            if v not in at:
                at[v] = len(self.vectors)
                self.vectors.append(v)
            return at[v], low

        self.end, self.end_cost = number(END)
        one = []  # one[vector][class] = (vector before, cost added); the list grows as it is read
        for v in self.vectors:
            one.append([number(_before(kind, list(v))) for kind in range(CLASSES)])
        step, add = (np.array([[x[i] for x in row] for row in one]) for i in (0, 1))
        # a block's number has its first symbol in the highest place; it is read from its last
        self.step, self.add = np.arange(len(step))[:, None], np.zeros((len(step), 1), np.int64)
        for _ in range(block):
            # prepend a symbol: the shorter block first (it lies behind), then the new symbol
            moved = step[self.step]                                   # vector, short block, class
            cost = self.add[:, :, None] + add[self.step]
            self.step = moved.transpose(0, 2, 1).reshape(len(step), -1)
            self.add = cost.transpose(0, 2, 1).reshape(len(step), -1)
        self.one_step, self.one_add = step.tolist(), add.tolist()
        self.step, self.add = self.step.tolist(), self.add.tolist()
        self.letters = bytes(_class(max(b - 65, 0)) if 65 <= b < 81 else 0 for b in range(256))

    def solve(self, symbols: str) -> tuple[int, str]:
        """(cost, audit) of a conversation given as symbol letters."""
        kinds = symbols.encode("ascii").translate(self.letters)
        n, size = len(kinds), self.block
        head = n % size  # symbols before the first whole block
        codes = np.frombuffer(kinds, np.uint8, offset=head).astype(np.int64).reshape(-1, size) if n > head else \
            np.empty((0, size), np.int64)
        blocks = (codes @ CLASSES ** np.arange(size - 1, -1, -1)).tolist()
        v, total, behind = self.end, self.end_cost, []
        for b in reversed(blocks):  # by lookup; only the vector behind each block is kept
            behind.append(v)
            total += self.add[v][b]
            v = self.step[v][b]
        first = v
        for kind in reversed(kinds[:head]):
            total += self.one_add[v][kind]
            v = self.one_step[v][kind]
        total += self.vectors[v][_START]
        audit, q = [], _START
        for lo, hi, v in itertools.chain([(0, head, first)] if head else [], zip(
                range(head, n, size), range(head + size, n + 1, size), reversed(behind))):
            inside = [(v, 0)]
            for kind in reversed(kinds[lo:hi]):  # expand this block's vectors from its end
                inside.append((self.one_step[inside[-1][0]][kind], self.one_add[inside[-1][0]][kind]))
            for i in range(lo, hi):
                here, shift = inside[hi - i]
                q = self._trace(kinds[i], q, self.vectors[here], shift, self.vectors[inside[hi - i - 1][0]], audit)
        while END[q]:
            audit.append("I")
            q = _NEXT[q, _EMITS[q]]
        return total, "".join(audit)

    def _trace(self, kind, q, here, shift, after, audit) -> int:
        """Adds the least letters that spend exactly the cost to go, up to and past one row."""
        initial, cut = divmod(kind - 1, 2)
        while True:
            left = here[q] + shift
            if left == DELETE + after[q]:
                audit.append("D")
                return q
            to = _NEXT[q, _EMITS[q]]
            if left == INSERT + here[to] + shift:
                audit.append("I")
                q = to
                continue
            own = _NEXT.get((q, (INITIALS + "?")[initial])) if kind else None
            if own is not None and left == KEEP + TRUNCATED * cut + after[own]:
                audit.append("K")
                return own
            audit.append("R")
            return to


class Repairer:
    """Lines of a repaired conversation, from its audit and its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, _START

    def _insert(self):
        while self.audit[self.at:self.at + 1] == "I":
            yield _ROLE[_EMITS[self.state]] + ":"
            self.state = _NEXT[self.state, _EMITS[self.state]]
            self.at += 1

    def row(self, role: str, text: str):
        yield from self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            role = _ROLE[_EMITS[self.state]]
        if edit != "D":
            self.state = _NEXT[self.state, role[:1]]
            yield f"{role}:{text}"

    end = _insert


# --- rows -------------------------------------------------------------------------------------
def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv, id, turn, role, text, n)``: ``conv`` is the id as text, ``n`` how often the row
    stands there. ``id`` and ``turn`` may be null; 0 stands for a row that damage dropped."""
    space = F.lit(" ")
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), space)
    fate = F.crc32(F.concat(as_text(conv), F.lit(":"), as_text(turn)).cast("binary")) % 20
    body = as_text(text)
    return rows.select(as_text(conv).alias("conv"), F.col(conv).alias("id"), F.col(turn).alias("turn"),
                       F.when(fate == 4, "user").otherwise(as_text(role)).alias("role"),
                       F.when(fate == 1, "").when(fate == 2, F.translate(body, ".!?", ""))
                        .otherwise(body).alias("text"),
                       F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("n"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text"), 256))


def _symbol_pieces(batches):
    """Ordered rows -> (conv, piece, symbols) for each run of one conversation in a batch."""
    for place, b in enumerate(batches):
        out, last = [], None
        for conv, s in zip(b.column("conv").to_pylist(), b.column("symbols").to_pylist()):
            if conv != last:
                out.append((conv, place, len(out), []))
                last = conv
            out[-1][3].append(s)
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()),
             pa.array(["".join(o[3]) for o in out], pa.string())], names=["conv", "batch", "symbols"])


def symbols(rows: DataFrame) -> DataFrame:
    """``(conv, symbols)``: the symbol letters of every conversation that has rows."""
    shown = F.expr("rtrim(concat(' ', '\t', '\n', char(11), '\f', '\r'), text)") if False else \
        F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
    end = F.right(shown, F.lit(1))
    fault = F.when(shown == "", 1).when(~end.isin(".", "!", "?"), 3).otherwise(0)
    initial = F.coalesce(*[F.when(F.left("role", F.lit(1)) == c, i) for i, c in enumerate(INITIALS)], F.lit(3))
    narrow = rows.filter("n > 0").select(
        "conv", "turn", "role", _digest().alias("digest"), fault.alias("fault"),
        initial.alias("initial"), "n").groupBy("conv", "turn", "role", "digest", "fault", "initial").agg(
        F.sum("n").alias("n"))
    narrow = saved(narrow, "turn-symbols")
    # texts that a conversation's role has said in several turns: the first turn is none
    again = narrow.filter("fault <> 1").groupBy("conv", "role", "digest").agg(
        F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("unplaced"),
        F.count("*").alias("turns")).filter("turns > 1").drop("turns")
    rest = F.when(F.col("fault") == 1, 1).otherwise(2)
    later = F.when(F.col("unplaced"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    own = F.when(later, 2).otherwise(F.col("fault"))
    letter = lambda f: F.char(F.col("initial") * 4 + f + 65)
    ordered = narrow.join(again, ["conv", "role", "digest"], "left").select(
        "conv", "turn", "role", "digest", F.concat(letter(own), F.repeat(letter(rest), (F.col("n") - 1).cast("int")))
        .alias("symbols"))
    order = ["conv", "turn", "role", "digest"]
    pieces = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "symbols") \
        .mapInArrow(_symbol_pieces, "conv string, batch int, symbols string") \
        .withColumn("part", F.spark_partition_id())
    whole = F.array_sort(F.collect_list(F.struct("part", "batch", "symbols")))
    return pieces.groupBy("conv").agg(F.array_join(F.transform(whole, lambda p: p["symbols"]), "").alias("symbols"))


def _illegal(symbols: str) -> int:
    initials = [(ord(s) - 65) // 4 for s in symbols]
    legal = {(0, 1), (1, 2), (2, 1)}
    return sum(p not in legal for p in zip(initials, initials[1:]))


def _solve(block: int):
    def run(batches):
        tables = per_worker(f"repair {block}", lambda: Tables(block))
        for b in batches:
            out = []
            for s in b.column("symbols").to_pylist():
                s = s or ""
                faults = [sum(s.count(chr(65 + 4 * i + f)) for i in range(4)) for f in (1, 2, 3)]
                out.append((*faults, _illegal(s), *tables.solve(s)))
            names = ("blank", "duplicate", "truncated", "illegal", "cost", "audit")
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv"), *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]], names=["conv", *names])
    return run


def solutions(symbol_rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conv, blank, duplicate, truncated, illegal, cost, audit)`` of conversations as symbols;
    null symbols are a conversation without rows."""
    return symbol_rows.select("conv", "symbols").mapInArrow(
        _solve(block), "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _stream(batches):
    """Ordered (conv, audit, role, text, n), each conversation's audit first -> (conv, sha)."""
    conv = repairer = digest = None
    some = False

    def feed(lines):
        nonlocal some
        for line in lines:
            digest.update((("\n" if some else "") + line).encode("utf-8", "surrogatepass"))
            some = True

    for b in batches:
        done = []
        for c, audit, role, text, n in zip(*(b.column(i).to_pylist() for i in range(5))):
            if audit is not None:
                if repairer:
                    feed(repairer.end())
                    done.append((conv, digest.hexdigest()))
                conv, repairer, digest, some = c, Repairer(audit), hashlib.sha256(), False
                continue
            for _ in range(n):
                feed(repairer.row(role, text))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done)], names=["conv", "sha"])
    if repairer:
        feed(repairer.end())
        yield pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["conv", "sha"])


def repair(conversations: DataFrame, conv: str, turn: str, role: str, text: str, block: int = BLOCK) -> DataFrame:
    """One row per conversation: ``(id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256)``, after damage by the checksum of id and turn."""
    rows = damaged(conversations, conv, turn, role, text)
    # turns first, then conversations: both counts combine before they are shuffled
    alive = F.col("n") > 0
    turns = rows.groupBy("conv", "id", "turn").agg(F.max(alive).alias("alive"))
    seen = F.when(F.col("alive"), F.col("turn").cast("decimal(38,0)"))
    base = turns.groupBy("conv", "id").agg(
        F.coalesce(F.max(seen) - F.min(seen) + 1 - F.count(seen), F.lit(0)).alias("gaps"))
    base = base.select("conv", "id", F.expr("try_cast(gaps AS long)").alias("gaps"))
    found = saved(base.join(symbols(rows), "conv", "left"), "conversation-symbols")
    solved = saved(solutions(found, block), "conversation-edits")
    texts = rows.filter("n > 0").select("conv", F.lit(None).cast("string").alias("audit"), "role", "text", "n",
                                        "turn", _digest().alias("digest"))
    heads = solved.select("conv", "audit", F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("string").alias("text"), F.lit(0).alias("n"),
                          F.lit(None).cast(texts.schema["turn"].dataType).alias("turn"),
                          F.lit(None).cast("binary").alias("digest"))
    lines = texts.unionByName(heads).repartition("conv").sortWithinPartitions(
        "conv", F.col("audit").isNull(), "turn", "role", "digest").select("conv", "audit", "role", "text", "n")
    shas = lines.mapInArrow(_stream, "conv string, sha string")
    return found.select("conv", "id", "gaps").join(solved, "conv").join(shas, "conv").select(
        "id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
