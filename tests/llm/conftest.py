import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, line string, hash long, pos int, key string, part int, m long, score double"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(rng.randint(2, 9))) for _ in range(n))


def messy_rows():
    """Nulls, empty and long texts, copies, near copies, shared lines and passages, a hot source."""
    rng = random.Random(5)
    rows, passage, line = [], words(rng, 60), "Shared   boilerplate line of text"
    base = words(rng, 300)
    for i in range(90):
        text = "\n".join(words(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 8)))
        if i % 4 == 0:
            text += f"\n  {line.upper() if i % 8 else line}\t\n"
        if i % 7 == 0:
            text += "\n" + passage + " " + words(rng, 5)
        if i % 11 == 0:
            w = base.split()
            w[rng.randrange(300)] = "changed"
            text = " ".join(w)
        if i % 13 == 0:
            text = base
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 5}", len(text)))
    rows += [(100, None, "en", "hot", None), (101, "", None, None, 0), (102, "   \n\t ", "fr", None, 6), (103, "é ü ß 你好 \U0001f600", "de", "s1", 9)]
    rows += [(104, "same " * 3000, "en", "s2", 15000), (105, base, "en", "zz", len(base)), (106, "Word", "en", "Z", 4), (107, "word", "en", "é", 4)]
    return [(*r, 1, "x", 2, 3, "k", 4, 5, 0.5) for r in rows]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that repeat, a repeated id with other text, and a null id."""
    rows = [(1, "one two three four five " * 9), (1, "one two three four five " * 9), (1, "other text of the same id"), (None, "no id"), (2, None), (2, None)]
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", 2, 3, "k", 4, 5, 0.5) for i, t in rows], SCHEMA)
