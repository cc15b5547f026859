import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text[, source]) rows."""
    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return build


@pytest.fixture
def odd(make):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    from pyspark.sql import functions as F
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, ""), (3, None), (None, "x y z"), (None, None), (4, long), (5, "a b c d e f g h"),
            (6, " \t\n "), (7, "one", None), (8, "é ß ü 漢字 🎉 text", None), (9, "a" * 50_000)]
    clash = ("score", "size", "n", "sid", "key", "h", "target", "source_size", "copies", "root", "shard", "bytes", "at", "words", "pred", "root_", "ids", "u", "v")
    return make(rows).withColumns({c: F.lit(1) for c in clash})


@pytest.fixture
def none(make):
    return make([(1, "x")]).where("doc_id < 0")
