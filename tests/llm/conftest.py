import pytest

LONG = "Lorem ipsum dolor sit amet " * 9000 + "end\n" + "x" * 70_000 + "\n" + "token = \"" + "0123456789abcdef" * 3 + "\""
ODD = [
    (None, None), (None, "no id but words in it, quite a few of them"), (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"),
    (5, "The same id with another text, first of two."), (5, "The same id with another text, second of two!"), (6, "😀 émoji ñ ß İ ς 漢字 \u00a0 \u2028 end"),
    (7, LONG), (8, "a\u0000b\x1c\x85 mail bob.smith@example.com now, ip 10.0.0.256 and 192.168.1.77"), (-9, "negative id with several words in a row"), (2**63 - 1, "huge id with several words in a row too"),
    (10, "Line one is fine.\nLine two is fine as well.\n\n\n"), (11, "4111 1111 1111 1111 and +1 (415) 555-2671 and 1.2.3.4.5.6.7.8"), (12, "a@b@c.d@e.f.g +12 --- 4111-1111-1111-1111-"),
    (13, "ends here<|endoftext|><|startoftext|> J\u030c and H\u0331 done"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns."""
    extra = "block long, n long, root long, node long, quality_score double, `a.b` string, findings string, redacted string, part int, guest int, length long, chunk long, _hits string, row string"
    values = (1, 2, 3, 4, 0.5, "x", "f", "r", 9, 8, 7, 6, "h", None)
    return spark.createDataFrame([(i, t, None, *values) for i, t in ODD], f"doc_id long, text string, lang string, {extra}").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def plain(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}
