import pytest
from fixture_texts import texts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    out = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())]
    return [*out, out[3], (None, "no id here " * 30, None, None, None)]  # a repeated row and a null id


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def tables(spark, rows, tmp_path_factory):
    """A folder of the tables that the queries read."""
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int("scumbag" in (t or ""))) for i, t, *_ in rows if i is not None] + [(None, 1, 1), (5, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    chats = [(1, 0, "user", "hi ### there"), (1, 1, "assistant", "</turn> \\h yes"), (1, 2, None, None), (1, 3, "assistant", ""), (2, 0, "sys\ntem", "x\n"), (None, 0, "user", "q"), (2, 0, "assistant", "tie")]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    page = "<html><body><nav><a href=1>home</a></nav><article><h1>A &amp; b</h1><p>some   words that\nmake a text<p>and more of them</article><footer>(c)</footer></body>"
    pages = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>" * 50), (1, "u", page)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.fixture(scope="session")
def no_rows(spark, tmp_path_factory):
    """The same tables without rows."""
    path = tmp_path_factory.mktemp("empty")
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("conversations", "conv_id long, turn long, role string, text string"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)
