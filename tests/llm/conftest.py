import pytest

WORDS = ("the stone river keeps its old course while small boats drift past quiet houses and people wait for "
         "evening light before they walk home along the narrow path").split()


def sentence(seed, n):
    return " ".join(f"{WORDS[(seed * 7 + i * (seed % 5 + 1)) % len(WORDS)]}{(seed + i * i) % 11}" for i in range(n))


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls in every column, empty and long texts, repeated rows, near copies."""
    long = "\n".join(sentence(i, 40) for i in range(60))
    near = sentence(3, 80)
    rows = [
        (1, sentence(1, 30), "en", "a", 1), (2, sentence(2, 30) + "\n" + sentence(1, 30), "en", "a", 1),
        (3, near, "en", "b", 1), (4, near + " tail", None, "b", 1), (5, near, "de", None, None),
        (6, None, "en", "a", None), (7, "", "en", "a", 0), (8, " \n\t\n ", "en", "a", 1), (9, long, "en", "a", 1),
        (None, sentence(5, 25), None, None, None), (None, sentence(5, 25), None, None, None),
        (10, sentence(6, 25), "en", "a", 1), (10, sentence(6, 25), "en", "a", 1), (11, "short", "en", "c", 1),
        (12, "a&&& b### " * 30, "en", "c", 1), (13, "Ünïcödé 漢字 \U0001F600 don't  stop\r\n\x85x", "xx", "c", 1),
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def clashing(tricky):
    """Extra columns with the names that the operators use inside."""
    from pyspark.sql import functions as F
    for c in ("row_id", "stats", "quality", "words", "found", "line_key", "shard_key", "found_ids", "fence", "pseudonymised"):
        tricky = tricky.withColumn(c, F.lit("x"))
    return tricky
