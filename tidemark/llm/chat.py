"""Chat formatting of heterogeneous conversation records.

Records are JSON objects in any of several layouts (prompt/response, instruction/output,
question/answer, message lists under different names). A record's fingerprint is a hash of
the nested field paths it has, out of the paths that any mapping knows, so extra fields don't
matter. The fingerprint selects a declarative mapping, which turns the record into canonical
turns (role, text). Turns are rendered with a template whose control strings are escaped in
texts, so the turns can be read back exactly. DataFrame functions only.

Defined results: a null text or role is the empty string; a record that fits no mapping has
null turns and mapping ``None`` (never a guess); repeated records are formatted each.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import between, in_pieces, let, running

TURNS = "array<struct<role:string, text:string>>"


@dataclass(frozen=True)
class Mapping:
    """One layout. ``required`` and ``optional`` are field paths (``list[].field`` for lists).

    ``turns`` lists (role, path) pairs in order; for a list layout it is one pair
    (role path, text path) and ``roles`` renames the roles found there.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    list_of: str | None = None
    roles: dict = field(default_factory=dict)

    def path_sets(self):
        for n in range(len(self.optional) + 1):
            for more in itertools.combinations(self.optional, n):
                yield tuple(sorted(self.required + more))


#: The layouts that public instruction and chat corpora use.
MAPPINGS = (
    Mapping("messages", ("messages[].role",), ("messages[].content",), (("role", "content"),), "messages"),
    Mapping("turns", ("conversations[].from",), ("conversations[].value",), (("from", "value"),),
            "conversations", {"human": "user", "gpt": "assistant"}),
    Mapping("prompt_response", ("prompt", "response"), ("system",),
            (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("prompt", "completion"), ("system",),
            (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"),
            (("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
    Mapping("question", ("question", "answer"), ("system",),
            (("system", "system"), ("user", "question"), ("assistant", "answer"))),
)


def known_paths(mappings: Sequence[Mapping] = MAPPINGS) -> list[str]:
    return sorted({p for m in mappings for p in m.required + m.optional})


def record_schema(mappings: Sequence[Mapping] = MAPPINGS) -> str:
    """Type of the union of all layouts; fields outside it are not parsed."""
    lists, plain = {}, []
    for p in known_paths(mappings):
        if "[]." in p:
            outer, inner = p.split("[].")
            lists.setdefault(outer, []).append(inner)
        else:
            plain.append(p)
    parts = [f"{o}: array<struct<{', '.join(f'`{i}`: string' for i in ins)}>>" for o, ins in lists.items()]
    return f"struct<{', '.join(parts + [f'{p}: string' for p in plain])}>"


def _present(rec: Column, path: str) -> Column:
    if "[]." in path:
        outer, inner = path.split("[].")
        return F.coalesce(F.exists(rec[outer], lambda x: x[inner].isNotNull()), F.lit(False))
    return rec[path].isNotNull()


def fingerprint(rec: Column, mappings: Sequence[Mapping] = MAPPINGS) -> Column:
    """64-bit hash of the sorted known field paths that the record has."""
    paths = known_paths(mappings)
    return F.xxhash64(F.concat_ws("\n", *[F.when(_present(rec, p), F.lit(p)) for p in paths]))


def _turns(rec: Column, m: Mapping) -> Column:
    if m.list_of:
        role, text = m.turns[0]

        def turn(x):
            r = F.coalesce(x[role], F.lit(""))
            for old, new in m.roles.items():
                r = F.when(x[role] == old, F.lit(new)).otherwise(r)
            return F.struct(r.alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))

        return F.transform(rec[m.list_of], turn)
    made = []
    for role, path in m.turns:
        if "+" in path:
            first, more = path.split("+")
            text = F.when(F.coalesce(rec[more], F.lit("")) == "", rec[first]) \
                    .otherwise(F.concat_ws("\n\n", rec[first], rec[more]))
        else:
            text = rec[path]
        made.append(F.when(text.isNotNull(), F.struct(F.lit(role).alias("role"), text.alias("text"))))
    return F.array_compact(F.array(*made))


def canonical_turns(df: DataFrame, record: str = "record",
                    mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """Adds ``fingerprint``, ``mapping`` and ``turns`` to records in the JSON column ``record``."""
    df = df.withColumn("_rec", F.from_json(record, record_schema(mappings),
                                           {"maxStringLen": "2147483647"}))
    df = df.withColumn("fingerprint", fingerprint(F.col("_rec"), mappings))
    mapping, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in reversed(mappings):
        # the same hash, of the paths each form of the layout has
        forms = [F.xxhash64(F.lit("\n".join(s))) for s in m.path_sets()]
        fits = F.col("fingerprint").isin(*forms)
        mapping = F.when(fits, F.lit(m.name)).otherwise(mapping)
        turns = F.when(F.col("mapping") == m.name, _turns(F.col("_rec"), m)).otherwise(turns)
    return df.withColumn("mapping", mapping).withColumn("turns", turns).drop("_rec")


# ---- template -----------------------------------------------------------------------------
# "### <role>: <text></turn>\n" for each turn. Roles are percent-encoded. In texts, "\" becomes
# "\\", "#" becomes "\#" and "</" becomes "<\/", so neither "###" nor "</turn>" can stand in one.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    s = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    s = F.replace(s, F.lit("#"), F.lit("\\#"))
    return F.replace(s, F.lit("</"), F.lit("<\\/"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(df: DataFrame, turns: str = "turns", trained: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``: code-point spans (end exclusive) of ``formatted``
    that hold the texts of the ``trained`` role."""
    df = df.withColumn("_pieces", F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(OPEN), F.url_encode(t["role"]), F.lit(MIDDLE)).alias("head"),
        escape(t["text"]).alias("body"), (t["role"] == trained).alias("loss"))))
    df = df.withColumn("formatted", F.array_join(F.transform(
        "_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), ""))
    ends = running(F.transform("_pieces", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)),
                   lambda a, b: a + b, 0)
    placed = F.zip_with("_pieces", ends, lambda p, end: F.struct(
        (end - len(CLOSE) - F.length(p["body"])).alias("start"), (end - len(CLOSE)).alias("end"), p["loss"]))
    spans = F.transform(F.filter(placed, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["end"]))
    return df.withColumn("loss_spans", spans).drop("_pieces")


def read_turns(formatted: Column) -> Column:
    """The turns of a rendered conversation, read back from its text."""
    parts = F.filter(F.split(formatted, "</turn>\n", -1), lambda p: p != "")

    def turn(p):
        at = F.locate(MIDDLE, p)
        return F.struct(F.url_decode(F.substring(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"),
                        unescape(F.substring(p, at + len(MIDDLE), F.length(p))).alias("text"))

    return F.transform(parts, turn)


def read_loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return let(in_pieces(formatted), lambda p: F.array_join(F.transform(
        loss_spans, lambda s: unescape(between(p, s["start"], s["end"]))), ""))


def records_from_rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One JSON record per conversation from rows by turn: (``conv``, ``record``).

    Turns come in the order (turn, role, text), nulls first. A user/assistant exchange gives
    a prompt/response record, one with a system turn before it has that too, anything else a
    message list. A conversation is one row, since its output is one text: its size is the
    bound of a row here.
    """
    t = rows.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(
        F.coalesce(F.col(turn).cast("long"), F.lit(-2 ** 63).cast("long")).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("content")))).alias("_t"))
    roles = F.transform("_t", lambda x: x["role"])
    content = lambda i: F.col("_t")[i]["content"]
    as_list = F.to_json(F.struct(F.transform("_t", lambda x: F.struct(x["role"], x["content"]))
                                 .alias("messages")))
    pair = F.to_json(F.struct(content(0).alias("prompt"), content(1).alias("response")))
    three = F.to_json(F.struct(content(0).alias("system"), content(1).alias("prompt"),
                               content(2).alias("response")))
    is_ = lambda *r: roles == F.array(*[F.lit(x) for x in r])
    return t.select(conv, F.when(is_("user", "assistant"), pair)
                    .when(is_("system", "user", "assistant"), three).otherwise(as_list).alias("record"))
