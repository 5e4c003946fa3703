import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, k1 string, part int, decoded string"
WORDS = [a + b + c for a in ("ka", "to", "mi", "re", "su", "lo") for b in ("na", "ri", "vo", "te") for c in ("", "n", "s", "la")]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def doc(i, text):
    return (i, text, "en", "s", len(text or ""), "x", 7, "k", 3, "d")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, ties."""
    rnd = random.Random(4)
    base = "\n".join(prose(rnd, 12) for _ in range(30))
    rows = [doc(i, prose(rnd, rnd.randrange(5, 120)) + ".\n" + prose(rnd, 9)) for i in range(40)]
    rows += [doc(40, None), doc(41, ""), doc(42, "   "), doc(43, "!!! ???"), doc(44, "one"), doc(45, "two words")]
    rows += [doc(None, "a document without an id " + base), doc(None, None)]
    rows += [doc(46, base), doc(47, base), doc(48, base.replace(WORDS[0], "x", 1)), doc(49, base + "\n" + prose(rnd, 3)), doc(46, base)]
    rows += [doc(50, prose(rnd, 30_000)), doc(51, "a" * 5000), doc(52, ("line of the page\nother line\n" * 200)), doc(53, "é漢字 \U0001f600 <|endoftext|> tail\n\n"), doc(54, "\r\n\t x")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
