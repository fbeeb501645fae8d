import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cid long, body string, token string"


def words(n, seed):
    import random

    r = random.Random(seed)
    return [("w%d" % r.randrange(5000)) for _ in range(n)]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, ties, repeated rows, clashing column names."""
    base = words(120, 1)
    near = base[:60] + ["changed"] + base[61:]
    far = base[:20] + words(100, 2)
    rows = [
        (1, " ".join(base)), (2, " ".join(base)), (3, "  ".join(base)), (4, " ".join(near)), (5, " ".join(far)),
        (6, None), (7, ""), (8, " \t\n"), (9, "one"), (10, "One"), (11, "one two"), (12, "1234 ... !!!"),
        (13, " ".join(words(30000, 3))), (14, "Released under the MIT License. under the mit license apache license version 2"),
        (15, "x" * 50000), (16, "É ü ß naïve café 漢字 é"), (17, " ".join(base[::-1])),
        (17, " ".join(base[::-1])), (None, "orphan text with words"), (None, None), (19, "a b c d e f g h i j k l"), (20, "a b c d e f g h i j k l m"),
        (21, "<|endoftext|> and \x01 sign"), (22, "Licensed under CC BY-NC 4.0. All rights reserved."),
    ]
    data = [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", len(t or ""), k, "clash", "clash") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
