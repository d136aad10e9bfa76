import pytest

#: Texts that exercise the edges every operator must define.
EDGE_TEXTS = [
    None, "", " \t\n", "a", "a b", "token = abcdefghijklmnop", "same same", "same same",
    "One line here.\nHome | About | Contact | Help\nOne line here.\n\n All rights reserved.",
    "été ☃ 漢字かな交じり文  x", "pass\x00word", "x" * 5000, "w1 w2 w3 " * 700,
    " ".join(f"word{i}" for i in range(3000)), "<|endoftext|> inside <s> </s> <0x0A>\r\n\ttab",
    "tail  spaces   ", "# $ % & | < > *** ### !!!",
]


def write_docs(spark, path, texts, extra=True):
    """A documents table with the given texts; ids from 0, the last id twice where asked."""
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t), "clash") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        schema += ", kept string"
    else:
        rows = [r[:5] for r in rows]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    return write_docs(spark, tmp_path_factory.mktemp("edge"), EDGE_TEXTS)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    path = write_docs(spark, tmp_path_factory.mktemp("empty"), [], extra=False)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int") \
        .write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string") \
        .write.parquet(f"{path}/conversations.parquet")
    return path


SMALL = "/root/testdata/sf0.001"


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
