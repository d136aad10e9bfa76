"""Line-first quality rules.

A document is judged line by line: lines that fail a punctuation, navigation or boilerplate
rule are removed, and a document is rejected when the removed lines held too much of its
text. Document statistics (words, symbols, repeated lines, repeated 8-word windows) give a
base verdict beside it. Everything is an expression over the one row, so the plan is a scan
and a projection: no shuffle, no Python.

Repeated windows are compared by 64-bit hashes (``xxhash64`` of their words' hashes), so two different windows of one document count as equal with probability 2**-64.

Defined results: a null text has no words and no lines; repeated rows are judged each;
columns beyond the text are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import SPACE_CLASS, SPACES, word_array

SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture, in lower case, as patterns: English, French, German, Spanish, any.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "uses cookies", "accept cookies", "privacy policy",
    "terms of use", "terms of service", "terms and conditions", "subscribe to our newsletter",
    "sign up for our newsletter", "please enable javascript", "javascript is disabled",
    "click here to", "follow us on", "share this article", "back to top", "skip to content",

    "tous droits réservés", "politique de cookies", "utilise des cookies", "accepter les cookies",
    "politique de confidentialité", "mentions légales", "conditions d['’]utilisation",
    "conditions générales de vente", "abonnez-vous à notre", "inscrivez-vous à notre",
    "veuillez activer javascript", "javascript est désactivé", "cliquez ici pour", "suivez-nous sur",
    "partager cet article", "retour en haut", "aller au contenu",

    "alle rechte vorbehalten", "cookie-richtlinie", "verwendet cookies", "cookies akzeptieren",
    "datenschutzerklärung", "nutzungsbedingungen", "allgemeine geschäftsbedingungen",
    "newsletter abonnieren", "abonnieren sie unseren newsletter", "bitte aktivieren sie javascript",
    "javascript ist deaktiviert", "klicken sie hier", "folgen sie uns auf", "diesen artikel teilen",
    "nach oben scrollen", "zurück zum seitenanfang", "zum inhalt springen",

    "todos los derechos reservados", "política de cookies", "utiliza cookies", "aceptar (?:las )?cookies",
    "política de privacidad", "aviso legal", "términos de uso", "términos y condiciones",
    "condiciones de uso", "suscríbete a nuestro", "suscríbase a nuestro", "javascript está desactivado",
    "ha(?:z|ga) clic aquí", "síguenos en", "compart(?:e|ir) este artículo", "volver arriba", "saltar al contenido",

    "copyright ©", "© (?:19|20)[0-9][0-9]",
)


def phrase_pattern() -> str:
    """Matches a phrase that begins where a word does; those with the same first letter stand
    together, so that a place in a text is tried by one letter each."""
    by_first: dict[str, list[str]] = {}
    for p in BOILERPLATE:
        by_first.setdefault(p[0], []).append(p[1:])
    return "(?:^|[^a-zß-ÿ])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + ")"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; shares are of a line's characters outside white space."""

    max_punctuation: float = 0.10   # runs of marks: !?#*$%&|<>~=_^
    min_separators: int = 3         # navigation: this many | > or arrows between words ...
    separator_share: float = 0.25   # ... and at least this many for each word
    unfinished_words: int = 2       # shorter lines must end in a mark that ends a sentence
    boilerplate_words: int = 30     # a line with a phrase of BOILERPLATE and no more words fails
    max_lost: float = 0.5           # share of a document's characters that may go


MARKS = r"!?#*$%&|<>~=_^"
_ENDINGS = r"""[.!?:;,"'”’»)\]…。！？]"""
_NAV = "|>»›→•"
_WORD = r"[^\x20\x09-\x0D]"


def _set(characters: str) -> str:
    return "[" + "".join("\\" + c if c in "^]\\" else c for c in characters) + "]"


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, _set(characters), ""))


def _solid(text: Column) -> Column:
    """Characters outside white space."""
    return F.length(F.regexp_replace(text, SPACE_CLASS + "+", ""))


def line_fails(line: Column, rules: LineRules, phrases: bool) -> Column:
    """Whether a line with a word fails a rule. ``phrases``: whether to look for boilerplate.

    Each rule has a cheap test first, since almost all lines pass. The expression uses nothing
    but the line: it stands in a lambda, where a column from outside, which the optimiser may
    replace by what it is made from, would be worked out again for every line.
    """
    marks, separators, words = _count(line, MARKS), _count(line, _NAV), F.size(word_array(line))
    some = line.rlike(f"(?s){_set(MARKS + _NAV)}(?:.*?{_set(MARKS + _NAV)}){{2}}")
    punctuation = some & (marks >= 3) & (marks > rules.max_punctuation * _solid(line))
    navigation = some & (separators >= rules.min_separators) & (separators >= rules.separator_share * words)
    unfinished = ~line.rlike(_ENDINGS + r"\s*$") & (words <= rules.unfinished_words)
    fails = punctuation | navigation | unfinished
    if phrases:
        fails = fails | F.lower(line).rlike(_PHRASES) & (words <= rules.boilerplate_words)
    return line.rlike(_WORD) & fails


_PHRASES = phrase_pattern()


def _suspect(rules: LineRules) -> str:
    """Matches every text with a line that may fail the punctuation or navigation rule, so that
    other texts are read once and not line by line. Only \\n ends a line."""
    either = _set(MARKS + _NAV)
    short = rf"^[^\S\n]*+\S++(?:[^\S\n]++\S++){{0,{max(rules.unfinished_words - 1, 0)}}}+(?<!{_ENDINGS})[^\S\n]*+$"
    return rf"(?md)(?:{either}(?:[^\n]*?{either}){{2}}|{short})"


def _judge(rules: LineRules, phrases: bool):
    return lambda x: F.struct(x.alias("line"), line_fails(x, rules, phrases).alias("fails"))


def clean_lines(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Adds ``cleaned`` (the text without failing lines), ``n_lines``, ``n_lines_removed``,
    ``lost_share`` and ``lines_kept_enough``.

    Lines without a word are neither judged nor counted as lost. A text without failing lines
    is returned unchanged.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(value, "\n", -1)
    judged = {p: F.transform(lines, _judge(rules, p)) for p in (True, False)}
    df = df.withColumn("_lines", F.when(F.lower(value).rlike(_PHRASES), judged[True])
                       .when(value.rlike(_suspect(rules)), judged[False]))
    df = df.withColumn("_gone", F.coalesce(F.filter("_lines", lambda x: x["fails"]), F.expr(
        "cast(array() as array<struct<line:string, fails:boolean>>)")))
    some = F.size("_gone") > 0
    kept = F.transform(F.filter("_lines", lambda x: ~x["fails"]), lambda x: x["line"])
    lost = F.aggregate("_gone", F.lit(0), lambda n, x: n + _solid(x["line"]))
    df = df.withColumns({
        "cleaned": F.when(some, F.array_join(kept, "\n")).otherwise(F.col(text)),
        "n_lines": (F.length(value) - F.length(F.replace(value, F.lit("\n"))) + 1).cast("long"),
        "n_lines_removed": F.size("_gone").cast("long"),
        "lost_share": _worked_out(F.when(some, lost / _solid(value)).otherwise(0.0))})
    return df.withColumn("lines_kept_enough", F.col("lost_share") <= rules.max_lost) \
             .drop("_lines", "_gone")


def _worked_out(value: Column) -> Column:
    """``value``, fixed where it stands. The optimiser moves a filter on a column below the
    projections that make it, and writes out everything it is made from there; for these
    columns that would repeat the work on whole texts many times. It leaves expressions that
    depend on the row's place alone, so the value is given to every row through one.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def repeated_window_words(df: DataFrame, words: str, out: str, width: int = 8) -> DataFrame:
    """Adds ``out``: words covered by ``width``-word windows that occur twice or more in the
    row's word array, the first occurrence included."""
    n = F.size(words)
    df = df.withColumn("_each", F.transform(words, lambda w: F.xxhash64(w)))
    count = F.greatest(n - (width - 1), F.lit(0))
    shifted = [F.slice("_each", i + 1, count) for i in range(width)]
    df = df.withColumn("_h", F.transform(F.arrays_zip(*shifted), lambda s: F.xxhash64(s))).drop("_each")
    last = "_h"
    df = df.withColumn("_sorted", F.when(
        F.size(F.array_distinct(last)) < F.size(last),
        F.array_sort(F.arrays_zip(F.col(last).alias("h"), F.sequence(F.lit(0), F.size(last) - 1).alias("p")))))
    m = F.size("_sorted") - 1
    df = df.withColumn("_at", F.sort_array(F.array_distinct(F.flatten(F.transform(
        F.filter(F.arrays_zip(F.slice("_sorted", 1, m).alias("x"), F.slice("_sorted", 2, m).alias("y")),
                 lambda z: z["x"]["h"] == z["y"]["h"]),
        lambda z: F.array(z["x"]["p"], z["y"]["p"]))))))
    k = F.size("_at") - 1
    covered = width + _sum(F.zip_with(F.slice("_at", 1, k), F.slice("_at", 2, k),
                                      lambda a, b: F.least(b - a, F.lit(width))))
    return df.withColumn(out, _worked_out(F.when(F.col("_at").isNotNull() & (n >= width), covered)
                                          .otherwise(0).cast("long"))).drop(last, "_sorted", "_at")


def quality(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Every row with its statistics, ``base_failed``, the line rules' columns and ``kept``."""
    value = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_w", word_array(value)).withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    df = repeated_window_words(df, "_w", "n_repeat_words").drop("_w")
    df = df.withColumn("_full", F.filter(F.split(value, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    df = df.withColumns({
        "n_symbols": _count(value, SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long")}).drop("_full")
    df = df.withColumn("base_failed", (F.col("n_words") < 20)
                       | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    df = clean_lines(df, text, rules)
    return df.withColumn("kept", ~F.col("base_failed") & F.col("lines_kept_enough"))
