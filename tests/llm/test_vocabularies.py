import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import SMALL, texts_of, write_docs
from tidemark.llm import packing, queries, sentencepiece_bpe, tokens

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

ALPHABET = "abcdeABC  \n\t▁éÉ漢字ñß☃😀'sΣσİ<s>0x1\".,\x00\x85 ́१!"
SPECIAL = ["<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "it's WE'LL 'T", "</s><unk><0x0A>", "ab" * 2000,
           "a" * 3001, " " * 700, "日本語テキスト" * 300, "aaa bbb" * 300, "x  <|endoftext|>\n\n"]


def noise(n=600):
    r = random.Random(1)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(60))) for _ in range(n)] + SPECIAL


@pytest.fixture(scope="session")
def noise_dir(spark, tmp_path_factory):
    return write_docs(spark, tmp_path_factory.mktemp("noise"), noise())


def where(which, edge_dir, noise_dir):
    return {"edge": edge_dir, "noise": noise_dir, "small": SMALL}[which]


@pytest.mark.parametrize("which", ["noise", "edge", "small"])
def test_token_counts(spark, edge_dir, noise_dir, which):
    d = where(which, edge_dir, noise_dir)
    tok = tokenizers.Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want = {}
    for k, t in texts_of(spark, d).items():
        n = len(tok.encode(t or "", add_special_tokens=False))
        want[k] = (len((t or "").encode()), n, n > 2048)
    assert {r.doc_id: tuple(r)[1:] for r in queries.op3_token_counts(spark, d).collect()} == want


def test_splitting_is_safe_and_bounded():
    text = "word " * 50 + "x" * 300 + "\t" + "é " * 40
    parts = list(tokens.split_safely(text, 64))
    assert "".join(parts) == text and all(len(p) <= 64 or " " not in p.strip() for p in parts)
    data = text.encode()
    parts = list(tokens.split_safely(data, 64))
    assert b"".join(parts) == data and all(len(p) <= 64 or b" " not in p.strip() for p in parts)
    batches = list(tokens.balanced([data, None, b"", data, "漢字 ".encode() * 500], 400))
    assert {i for rows, _ in batches for i in rows} == {0, 1, 2, 3, 4}
    sizes = [sum(map(len, parts)) for _, parts in batches]
    assert sum(sizes) == 2 * len(data) + 3500 and all(400 <= n < 800 for n in sizes[:-1])


def test_small_batches_and_table_give_the_same(spark, noise_dir):
    docs = spark.read.parquet(f"{noise_dir}/documents.parquet")
    path = queries.vocabulary("word_bpe_49k.json")
    a = tokens.token_counts(docs, "doc_id", "text", path).collect()
    lengths = tokens._library_lengths(path)
    counter = tokens.WordCounter(lengths, known=200_000)
    fullest = 0
    for r, t in zip(a, [x.text for x in docs.select("text").collect()]):
        assert r.n_tokens == sum(counter.counts(list(tokens.split_safely((t or "").encode(), 7))))
        fullest = max(fullest, counter.held)
    assert 100_000 < fullest <= 200_000  # it was filled, and emptied
    assert all(len(w) < 200 for w in counter.table)


def test_long_words_do_not_fill_the_table():
    path = queries.vocabulary("word_bpe_49k.json")
    counter = tokens.WordCounter(tokens._library_lengths(path), known=1 << 20)
    tok = tokenizers.Tokenizer.from_file(path)
    words = [f"{i}abc" * 1000 for i in range(30)]
    assert counter.counts([w.encode() for w in words]).tolist() == [len(tok.encode(w).ids) for w in words]
    assert not counter.table


def test_a_vocabulary_that_keeps_white_space_is_refused(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    with pytest.raises(Exception, match="doesn't drop white space"):
        tokens.token_counts(docs, "doc_id", "text", queries.vocabulary("byte_bpe_50k.json")).collect()


@pytest.mark.parametrize("which", ["noise", "edge", "small"])
def test_sentencepiece(spark, edge_dir, noise_dir, which):
    d = where(which, edge_dir, noise_dir)
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for k, t in texts_of(spark, d).items():
        ids = sp.encode(t or "")
        want[k] = (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    assert {r.doc_id: tuple(r)[1:] for r in queries.op7_sentencepiece(spark, d).collect()} == want


def test_long_units_equal_the_library_in_time_that_follows_their_length():
    import time
    path = queries.vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    model = sentencepiece_bpe.Model(path)
    r = random.Random(4)
    texts = ["the" * 1000, "".join(r.choice("abcdehinorst漢é") for _ in range(5000)), " " * 3000, "a" * 2000 + " b"]
    ids, at = model.encode(texts)
    for t, lo, hi in zip(texts, at, at[1:]):
        assert ids[lo:hi].tolist() == sp.encode(t)
    began = time.perf_counter()
    model.encode(["the" * 340_000])
    assert time.perf_counter() - began < 60


def test_decode_of_any_ids():
    path = queries.vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    model = sentencepiece_bpe.Model(path)
    r = random.Random(2)
    for _ in range(400):
        ids = [r.choice([r.randrange(3, 259), r.randrange(259, 32000)]) for _ in range(r.randrange(12))]
        assert model.decode(ids) == sp.decode(ids), ids


def pieces_of(ids, size=2048):
    points = packing.cut_points(len(ids), size)
    return [(k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes()))
            for k, (lo, hi) in enumerate(zip(points, [*points[1:], len(ids)]))]


@pytest.mark.parametrize("which", ["noise", "edge", "small"])
def test_packing(spark, edge_dir, noise_dir, which):
    d = where(which, edge_dir, noise_dir)
    tok = tokenizers.Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    want = {(k, *p) for k, t in texts_of(spark, d).items()
            for p in pieces_of(tok.encode(t or "", add_special_tokens=False).ids + [0])}
    rows = queries.op5_best_fit_packing(spark, d).collect()
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048
    total = sum(at.values())
    assert len(at) <= -(-total // 2048) * 1.02 + 1


def test_long_runs_go_to_the_library():
    library, ranks, pattern, special = queries.BYTE_BPE
    coder = packing.ByteBpe(queries.vocabulary(library), queries.vocabulary(ranks), pattern, special)
    for text in (" " * 1_500_000, "a" + "\n" * 1_200_000 + "b"):
        assert coder.encode(text).tolist() == coder.by_library(text)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_equals_a_plain_search(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 65, 300)
    got, offset = packing.best_fit_decreasing(lengths, 64)
    left = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [c for c in left if c >= lengths[i]]
        if fits:
            left[left.index(min(fits))] -= lengths[i]
        else:
            left.append(64 - lengths[i])
    used = np.bincount(got, lengths)
    assert sorted(64 - used) == sorted(left) and used.max() <= 64


def test_sequences_hold_the_ids(spark, edge_dir):
    library, ranks, pattern, special = queries.BYTE_BPE
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    args = (queries.vocabulary(library), queries.vocabulary(ranks), pattern, special)
    placed = packing.pack_documents(docs, "doc_id", "text", *args, size=512, shard_pieces=20)
    made = packing.sequences(placed, packing.pieces(docs, "doc_id", "text", *args, size=512, with_ids=True))
    seqs = {r.sequence_id: r.ids for r in made.collect()}
    assert max(map(len, seqs.values())) <= 512
    for r in placed.collect():
        ids = np.array(seqs[r.sequence_id][r.offset:r.offset + r.length], "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32


def test_empty(spark, empty_dir):
    for q in (queries.op3_token_counts, queries.op5_best_fit_packing, queries.op7_sentencepiece):
        assert q(spark, empty_dir).count() == 0
