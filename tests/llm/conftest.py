import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row long, score double"


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table of (id, text) pairs, with columns whose names operators use themselves."""

    def make(pairs):
        return spark.createDataFrame([(i, t, None, "s", len(t or ""), True, 7, None) for i, t in pairs], DOCS)

    return make


@pytest.fixture(scope="session")
def tables():
    """Whole texts of the smallest documents table, by id."""
    import duckdb

    def read(sql, sf="sf0.001"):
        con = duckdb.connect()
        for name in ("documents", "embeddings", "labels"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/{sf}/{name}.parquet'")
        return con.execute(sql).fetchall()

    return read


#: Null, empty, blank, short, repeated and long texts; null and repeated ids.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "Hello  World\n\nfoo "), (5, "Hello  World\n\nfoo "),
    (None, "same text as nothing else here"), (None, None), (6, "é́ 日本語 ß ſ İΣ <|endoftext|> \x1c\x85x"),
    (7, "lorem ipsum dolor " * 40_000), (8, "b c'll 12³ \r\n x"), (9, "x" * 5000), (10, "\n" * 50),
]


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD)


@pytest.fixture(scope="session")
def empty(docs):
    return docs([])
