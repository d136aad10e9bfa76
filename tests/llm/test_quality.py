import re
from collections import Counter

import pytest

from tests.llm.conftest import SMALL, texts_of, write_docs
from tidemark.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(hit), n < 20 or 100 * len(hit) > 30 * n)


REPEATS = ["a b c d e f g h " * 3 + "tail " + " ".join(f"u{i}" for i in range(60)),
           "x " * 100, " ".join(map(str, range(8))) + " mid " + " ".join(map(str, range(8))) + " end " * 7,
           "l one.\nl one.\n l one.\n\n\n", "a b c\x85d"]


@pytest.mark.parametrize("which", ["repeats", "edge", "small"])
def test_base_matches_brute_force(spark, tmp_path, edge_dir, which):
    d = {"edge": edge_dir, "small": SMALL}.get(which) or write_docs(spark, tmp_path / "t", REPEATS)
    got = {r.doc_id: tuple(r)[1:7] for r in queries.op2_quality_rules(spark, d).collect()}
    assert got == {k: brute(t) for k, t in texts_of(spark, d).items()}


def test_lines_and_verdict(spark):
    prose = "This is an ordinary sentence with a number of words in it."
    nav = "Home | About | Contact | Help"
    df = spark.createDataFrame([
        (0, "\n".join([" ".join(f"{w}{i}" for w in prose[:-1].split()) + "." for i in range(4)])),
        (1, "\n".join([prose, nav, "All rights reserved.", prose + " More."])),
        (2, "\n".join([nav + str(i) for i in range(9)] + [prose])),
        (3, "\n".join(f"BUY!! NOW!! CHEAP{i}!!" for i in range(20))), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert got[0].cleaned == got[0].text and got[0].kept and got[0].n_lines_removed == 0
    assert got[1].cleaned == prose + "\n" + prose + " More." and got[1].n_lines_removed == 2
    assert got[1].lines_kept_enough
    assert not got[2].lines_kept_enough and not got[2].kept
    assert got[3].cleaned == "" and not got[3].kept
    assert got[4].cleaned is None and not got[4].kept and got[4].lost_share == 0


FURNITURE = ["© 2024 Example Corp", "Tous droits réservés.", "Consultez nos Conditions d’utilisation ici.",
             "Diese Website verwendet Cookies, um Inhalte zu zeigen.", "Zum Inhalt springen.", "POLÍTICA DE PRIVACIDAD.",
             "Haga clic aquí.", "Aceptar las cookies y seguir.", "Conditions d'utilisation: page 3."]
PROSE = ["Le gâteau est servi avec tous les droits d'usage réservés.", "Sie verwendet Kekse, um den Teig zu mischen.",
         "La política de la ciudad cambió mucho en los últimos años.", "He rebuilt the call rights reserved list.",
         "Los préclicknuevos aquí no cuentan nada.", "Das Gebäude ©hat 2024 Fenster.", "Réaceptar cookies es raro."]


def test_page_furniture_of_four_languages(spark):
    rows = [(i, x) for i, x in enumerate(FURNITURE + PROSE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_lines_removed for r in quality.clean_lines(df).collect()}
    assert [got[i] for i in range(len(rows))] == [1] * len(FURNITURE) + [0] * len(PROSE)


def test_every_phrase_is_found_as_by_a_plain_search():
    plain = re.compile("(?:^|[^a-zß-ÿ])(?:" + "|".join(quality.BOILERPLATE) + ")")
    mine = re.compile(quality.phrase_pattern())
    found = [p for p in quality.BOILERPLATE if "[" not in p and "(" not in p]
    for p in found:
        assert mine.search(p) and mine.search(f"x {p} y") and not mine.search(p[:-1])
    for t in FURNITURE + PROSE + [f"é{p}" for p in found]:
        assert bool(mine.search(t.lower())) == bool(plain.search(t.lower()))


def test_empty(spark, empty_dir):
    assert queries.op2_quality_rules(spark, empty_dir).count() == 0


def test_texts_read_once_have_no_failing_line(spark):
    """The test on whole texts lets through none that a rule on lines would catch."""
    import random
    r = random.Random(8)
    bits = ["word", "two words", "a longer line of words here.", "x | y | z", "!!", "#", "end.", "\t", " ", "\r", "\x85",
            "menu", "A!! B!! C!!", "home > news > today", "…", "fin»"]
    texts = ["\n".join("".join(r.choice(bits + [" "] * 4) for _ in range(r.randrange(5))) for _ in range(r.randrange(6)))
             for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = quality.LineRules()
    got = {x.doc_id: x for x in quality.clean_lines(df).collect()}
    lines = df.selectExpr("doc_id", "posexplode(split(text, '\n', -1)) as (i, line)")
    fails = lines.select("doc_id", "i", "line", quality.line_fails(lines["line"], rules, True).alias("f")).collect()
    for k, t in enumerate(texts):
        mine = sorted((x.i, x.line, x.f) for x in fails if x.doc_id == k)
        assert got[k].cleaned == "\n".join(x for _, x, f in mine if not f), repr(t)
        assert got[k].n_lines == len(mine) and got[k].n_lines_removed == sum(f for _, _, f in mine)
