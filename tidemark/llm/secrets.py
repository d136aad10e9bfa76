"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its text). A ledger keeps, per
blob, which rule versions have been run on it and what each found, so a scan touches only
(blob, rule version) pairs that the ledger lacks; findings are joined back to all paths that
ever held the blob. Everything runs on DataFrame functions: matches and their code-point
offsets come from ``regexp_extract_all`` and ``split`` on the same pattern, whose pieces
alternate.

Defined results: a null text is the empty text; repeated rows each get their findings; an
empty table gives an empty result; columns beyond the key and the text are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import between, in_pieces, let, running, saved

LEDGER = ("blob_id string, rules array<string>, "
          "findings array<struct<start:int, end:int, ord:int, kind:string, rule:string>>")
_SPANS = "array<struct<start:int, end:int, ord:int, kind:string, rule:string>>"


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts when its group ``group`` has ``min_chars`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    min_chars: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


#: Base rules. For ``access`` and ``hex`` the length stands in the pattern: a match is a whole
#: run of its class, so runs that are too short match nowhere, as if matched and dropped.
#: ``assign`` can't do that, since a match that is dropped still uses up its text.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                      r"""([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}+"),
    Rule("hex", 1, r"[0-9a-f]{16,}+"),
)
#: A private key after its header: all up to the END line; where that is missing, the lines of
#: encapsulated headers and of base64. Breaks may be escaped ("\\n" in source and JSON) or, in
#: texts joined anew, blanks. Every loop is possessive, which Java runs without recursion.
_BREAK = r"(?:[\x20\t\r\n]|\\[nr])"
_PEM_BODY = (r"(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
             r"|(?:" + _BREAK + r"*+(?:Proc-Type|DEK-Info):\x20?[A-Za-z0-9,-]++"
             r"|" + _BREAK + r"*+[A-Za-z0-9+/=]{16,}+"
             r"|[\x20\t]*+(?:[\r\n]|\\[nr])" + _BREAK + r"*+[A-Za-z0-9+/=]++(?=[\x20\t]*+(?:[\r\n]|\\[nr]|$)))*+)")
#: Further kinds; each has a prefix that ordinary text doesn't produce.
MORE_RULES = (
    Rule("pem", 2, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----" + _PEM_BODY),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}+"),
)
RULES = BASE_RULES + MORE_RULES


def find_spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches as structs of code-point offsets, end exclusive."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    lens = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    vals = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) \
        if rule.group else lens
    empty = F.expr(f"cast(array() as {_SPANS})")
    # one gap more than matches: zipping by position drops nothing that a match needs
    parts = F.filter(F.arrays_zip(gaps.alias("gap"), lens.alias("len"), vals.alias("val")),
                     lambda m: m["len"].isNotNull())

    def spans(parts):
        ends = running(F.transform(parts, lambda m: m["gap"] + m["len"]), lambda a, b: a + b, 0)
        placed = F.zip_with(parts, ends, lambda m, end: F.struct(
            (end - m["len"]).alias("start"), end.alias("end"), F.lit(order).alias("ord"),
            F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule"), m["val"].alias("val")))
        kept = F.filter(placed, lambda s: s["val"] >= rule.min_chars)
        return F.transform(kept, lambda s: F.struct(s["start"], s["end"], s["ord"], s["kind"], s["rule"]))

    return F.when(text.rlike(rule.pattern), let(parts, spans)).otherwise(empty)


def with_blob_id(versions: DataFrame, text: str = "text") -> DataFrame:
    return versions.withColumn("blob_id", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def scan(versions: DataFrame, keys: Sequence[str], text: str = "text",
         ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """New ledger rows: one per blob that some rule version hasn't seen yet.

    A blob is scanned once, from one of the rows that hold it. Blobs are found by a partial
    minimum of the keys per blob id, so a text that a third of all rows share costs one row
    a task. ``ledger`` has the columns of ``LEDGER``; rows of one blob may be many.
    """
    keys = list(keys)
    v = with_blob_id(versions.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text")), "_text")
    holder = v.groupBy("blob_id").agg(F.min(F.struct(*keys)).alias("_holder"))
    if ledger is not None:
        done = ledger.groupBy("blob_id").agg(
            F.array_distinct(F.flatten(F.collect_list("rules"))).alias("_done"))
        holder = holder.join(done, "blob_id", "left")
    else:
        holder = holder.withColumn("_done", F.lit(None).cast("array<string>"))
    holder = holder.withColumn("_done", F.coalesce("_done", F.expr("cast(array() as array<string>)")))
    every = F.array(*[F.lit(r.key) for r in rules])
    holder = (holder.filter(F.size(F.array_except(every, F.col("_done"))) > 0)
              .withColumnsRenamed({"blob_id": "_blob"}).hint("shuffle_hash"))
    unseen = v.join(holder, (F.struct(*keys).eqNullSafe(F.col("_holder")))
                    & (F.col("blob_id") == F.col("_blob")))
    found = [F.when(~F.array_contains("_done", r.key), find_spans(F.col("_text"), r, i))
             .otherwise(F.expr(f"cast(array() as {_SPANS})")) for i, r in enumerate(rules)]
    rows = unseen.select("blob_id", F.array_except(every, F.col("_done")).alias("rules"),
                         F.concat(*found).alias("findings"))
    return rows.dropDuplicates(["blob_id"])  # rows repeated with their key hold one blob twice


def _hits(ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(blob_id, findings)`` of blobs in which ``rules`` found something.

    Written before it is joined: a join that shares its exchange with an aggregation can't be
    split, and a blob may be held by a third of all paths.
    """
    return saved(ledger.filter(F.size("findings") > 0)
            .filter(F.arrays_overlap("rules", F.array(*[F.lit(r.key) for r in rules])))
            .select("blob_id", F.explode("findings").alias("f"))
            .filter(F.col("f.rule").isin([r.key for r in rules]))
            .groupBy("blob_id").agg(F.array_sort(F.collect_set("f")).alias("findings")), "findings")


def findings_by_path(versions: DataFrame, keys: Sequence[str], ledger: DataFrame,
                     text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every path (row of ``versions``) with the spans that ``rules`` found in its blob."""
    paths = with_blob_id(versions.select(*keys, F.col(text).alias("_text")), "_text").drop("_text")
    return (paths.join(_hits(ledger, rules), "blob_id", "left")
            .withColumn("findings", F.coalesce("findings", F.expr(f"cast(array() as {_SPANS})"))))


def redacted(versions: DataFrame, ledger: DataFrame, text: str = "text",
             rules: Sequence[Rule] = RULES) -> DataFrame:
    """``versions`` with every span of their blob's findings replaced in ``text``."""
    hits = _hits(ledger, rules).withColumnsRenamed({"blob_id": "_blob", "findings": "_found"})
    rows = with_blob_id(versions.select(F.struct(*versions.columns).alias("_row"), F.col(text).alias("_text")), "_text")
    joined = rows.join(hits, F.col("blob_id") == F.col("_blob"), "left")
    done = F.when(F.col("_found").isNull(), F.col("_text")).otherwise(redact(F.col("_text"), F.col("_found")))
    return joined.select(*[(done if c == text else F.col("_row")[c]).alias(c) for c in versions.columns])


def scan_paths(versions: DataFrame, keys: Sequence[str], text: str = "text",
               ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES):
    """Scan what the ledger lacks; return (findings of every path, the grown ledger).

    The new ledger rows are written to the shared folder first, so findings and ledger come
    from one scan.
    """
    new = saved(scan(versions, keys, text, ledger, rules), "ledger")
    grown = new if ledger is None else ledger.unionByName(new)
    return findings_by_path(versions, keys, grown, text, rules), grown


def spans_string(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"]))),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by ``[REDACTED]``; overlapping spans become one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"])))

    def replaced(spans, pieces, before):
        cut = F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(before, i), F.concat(
            between(pieces, F.get(before, i), s["start"]), F.lit("[REDACTED]"))).otherwise(""))
        return F.concat(F.array_join(cut, ""), between(pieces, F.element_at(before, -1), F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(ordered, lambda o: let(in_pieces(text), lambda p: let(
        # how far the spans before each one reach
        F.concat(F.array(F.lit(0)), running(F.transform(o, lambda s: s["end"]), F.greatest, 0)),
        lambda u: replaced(o, p, u)))))
