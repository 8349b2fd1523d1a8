import pytest

#: Nulls in every column, empty and very long texts, ties, repeated rows, and clashing extra columns.
ODD = [
    (1, "a b c d e f g", "s1"), (2, "a  b\tc d e f g", "s1"), (3, None, "s2"), (4, "", None), (None, "a b c d e f g", "s1"),
    (5, "x", "s2"), (5, "x", "s2"), (6, "word " * 30_000, "s1"), (7, "é" * 70_000, "s3"), (8, None, None), (None, None, None),
    (9, "<|endoftext|> one <|endoftext|>", "s1"), (10, "   \n\n ", "s2"), (11, "Line one here\nLine two here\n", "s1"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", s, len(t or ""), 1, "k") for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, row string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


#: Names that operators use, or once used, for columns of their own.
CLASHING = (
    "target", "rate", "source_size", "_stratum", "_copies", "_copy", "_row", "_sha", "_id", "_nth", "_keep", "_digest", "digest", "size", "shard",
    "slot", "_n", "_slice", "_shard", "row", "whole", "n", "group", "score", "predicted", "held_out", "kept", "keep_id", "component_id",
)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    return odd.drop("size", "row").select("*", *(F.concat(F.lit(f"{c}:"), own).alias(c) for c in CLASHING))


def kept_apart(rows):
    """Whether every clashing column still has the value of its row."""
    return all(r[c] == f"{c}:{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in CLASHING)
