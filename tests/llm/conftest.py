import random

import pytest

SF = "/root/testdata/sf0.001"
#: Columns of operators' own results and steps, as extra columns of the input.
CLASHES = ["n_words", "n_tokens", "size", "key", "node", "part", "found", "score", "label", "kept", "target", "src", "n", "html", "host", "mix_epoch"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    words = "the of and river boat stone mill water under over little long house winter garden letter summer bread".split()
    return " ".join(r.choice(words) + (r.choice(["", "", "", "s", "ing"]) if r.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties of ids and sizes, clashing columns."""
    extra = ["x"] * len(CLASHES)
    long_text = prose(120_000, 1)
    rows = [
        (1, prose(80, 2), "en", "a", 1, *extra),
        (1, prose(80, 2), "en", "a", 1, *extra),
        (2, None, "en", "a", None, *[None] * len(CLASHES)),
        (3, "", None, None, 0, *extra),
        (4, " \n\t \n", "en", "b", 4, *extra),
        (None, prose(60, 3), "en", None, 1, *extra),
        (None, None, None, None, None, *[None] * len(CLASHES)),
        (5, long_text, "en", "c", 1, *extra),
        (6, long_text + " end", "en", "c", 1, *extra),
        (1, prose(90, 4), "en", "b", 1, *extra),
        (7, "one two", "de", "b", 7, *extra),
        (8, "One TWO", "de", "b", 7, *extra),
        (9, "日本語 テキスト ▁▁ é\u0301 \u00a0 \U0001f600 x", "ja", "b", 7, *extra),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
