import pytest


@pytest.fixture(scope="session")
def docs(spark, sf):
    """doc_id and text of the smallest documents, in Python."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r.doc_id, r.text or "") for r in rows)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names operators use themselves."""
    long = "word " * 30_000 + "end"
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "a"), (None, passage), (5, passage + " tail"), (5, passage + " tail"), (6, long), (7, "x" * 50_000),
        (8, "mail a.b@c.de now, call +1 (555) 123-4567"), (9, "日本語 ▁  é\x1c 😀\r\n"), (None, None), (10, "idiot idiot\n\n***"),
    ]
    names = ["lang", "score", "spans", "kept", "n_words", "node", "tokens", "length", "file", "_block", "_pii", "label"]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, *("x" for _ in names)) for r in rows], schema)


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
