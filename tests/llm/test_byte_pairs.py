import hashlib
import random

import numpy as np
import pytest

from tests.llm.conftest import SMALL, texts_of, write_docs
from tests.llm.test_vocabularies import noise
from tidemark.llm import byte_pairs, queries

tokenizers = pytest.importorskip("tokenizers")
PATH = queries.vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    r = random.Random(5)
    texts = noise() + [None, "", "ﬁ ǅ İstanbul ΑΣ ΑΣ. é  x y \x1c\x85z", "<|endoftext|><|startoftext|>x<|",
                       "x" * 70_000, "".join(chr(r.randrange(33, 127)) for _ in range(40_000)),
                       "漢字" * 9_000, " ".join("w%d" % (i % 977) for i in range(90_000)), "same", "same"]
    return write_docs(spark, tmp_path_factory.mktemp("odd"), texts)


def brute(texts):
    tok = tokenizers.Tokenizer.from_file(PATH)
    out = {}
    for k, t in texts.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    return out


@pytest.mark.parametrize("which", ["odd", "edge", "small"])
def test_equals_the_library(spark, edge_dir, odd_dir, which):
    d = {"odd": odd_dir, "edge": edge_dir, "small": SMALL}[which]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_byte_pairs(spark, d).collect()}
    assert got == brute(texts_of(spark, d))


def test_small_batches_and_tables_give_the_same(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    a = {r.id: r.ids for r in byte_pairs.encode(docs, "doc_id", "text", PATH).collect()}
    b = {r.id: r.ids for r in byte_pairs.encode(docs, "doc_id", "text", PATH, batch_bytes=300).collect()}
    assert a == b
    coder = byte_pairs.Coder(PATH, known_bytes=2000)
    for r in docs.filter("length(text) < 5000").select("doc_id", "text").collect():
        ids, at = coder.encode([r.text or "", "x y"])
        assert ids[:at[1]].astype("<u4").tobytes() == a[r.doc_id]


def one_by_one(coder, ids):
    """``ids`` after one merge after the other."""
    while True:
        found = [(coder.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in coder.merges]
        if not found:
            return ids
        i = min(found)[1]
        ids = ids[:i] + [coder.merges[ids[i], ids[i + 1]][1]] + ids[i + 2:]


def test_cuts_are_certain():
    """Fragments encoded alone give what merging whole words one pair at a time gives."""
    coder = byte_pairs.Coder(PATH)
    r = random.Random(3)
    words = [bytes(r.choice(b"abcdehinorst\xc3\xa9\xe6\xbc") for _ in range(r.randrange(1, 90))) for _ in range(300)]
    words += [b"a" * n for n in range(1, 40)] + [b"the" * 40]
    for word in words:
        keys, _ = coder.cut([word], [False])
        assert b"".join(k[:-1] for k in keys) == word
        ids, sizes = coder.encode_fragments(keys)
        want = one_by_one(coder, [coder.byte_ids[b] for b in word[:-1]] + [coder.end_ids[word[-1]]])
        assert ids.tolist() == want and len(sizes) == len(keys)
        inner = [coder.byte_ids[b] for b in word]
        assert coder.merge_long(list(inner)) == one_by_one(coder, inner)


def test_plain_characters_are_cut_as_the_library_cuts_them():
    coder = byte_pairs.Coder(PATH)
    chars = [chr(c) for c in range(1, 0x260)]
    words = [x for c in chars for x in (c, f"a{c}", f"{c}1", f"'{c}", f"{c}{c}A")] + ["it's", "'LL", "x'Re'd"]
    words = [w for w in words if not set(w) & set(" \t\n\x0b\f\r")]
    quick, _ = coder.encode_words(words)
    coder.find_words = None
    assert quick.tolist() == coder.encode_words(words)[0].tolist()


def test_decode_of_any_ids():
    names = byte_pairs.Names(PATH)
    tok = tokenizers.Tokenizer.from_file(PATH)
    pack = lambda ids: np.array(ids, "<u4").tobytes()
    got = names.decode([pack([5, 49407, 300]), b"", pack([49408, 4_000_000_000, 7]), None]).to_pylist()
    assert got == [tok.decode([5, 49407, 300], skip_special_tokens=False), "", tok.decode([7]), None]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        byte_pairs.Coder(queries.vocabulary("byte_bpe_50k.json"))


def test_long_runs_take_time_in_proportion():
    import time
    coder = byte_pairs.Coder(PATH)
    def seconds(n):
        began = time.perf_counter()
        coder.merge_long([coder.byte_ids[b] for b in b"the" * n])
        return time.perf_counter() - began
    assert seconds(80_000) < 40 * max(seconds(8_000), 0.01)


def test_empty_table_and_clashing_columns(spark, empty_dir):
    assert queries.op11_byte_pairs(spark, empty_dir).count() == 0
    df = spark.createDataFrame([(1, "a b", "x", [1])], "id long, text string, decoded string, ids array<int>")
    assert byte_pairs.encode(df, "id", "text", PATH).count() == 1
