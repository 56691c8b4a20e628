import random

import pytest

VOCABULARY = [a + b for a in ("th", "er", "on", "an", "re", "he", "in", "ed") for b in ("and", "our", "ing", "ble", "tion", "est")]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n)) + "."


def edge_rows():
    """Ids, texts and languages with nulls, empties, a very long text, ties, copies, near copies and junk."""
    rng = random.Random(9)
    rows = [(i, "\n".join(sentence(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 4))), "en") for i in range(40)]
    base = [rng.choice(VOCABULARY) + str(rng.randint(0, 99)) for _ in range(80)]
    rows += [(40 + k, " ".join([*base[: 79 - k], "changed", *base[80 - k :]]), "de") for k in range(6)]  # near copies
    rows += [(50 + k, rows[3][1], None) for k in range(4)]  # exact copies
    rows += [(60 + k, " ".join(w.upper() + "!!" for w in sentence(rng, 80).split()), "en") for k in range(8)]
    rows += [(70 + k, sentence(rng, 60) + " you idiot trash", "fr") for k in range(8)]
    rows += [(80, None, "en"), (81, "", "en"), (82, " \n\t ", None), (83, "word", "en"), (84, "a b\na b\n\nc  d é 中文 🙂 \x1c\x85 x", "zz")]
    rows += [(85, " ".join(f"w{i % 997}x{i}" for i in range(30_000)), "en"), (86, "x" * 60_000, "en")]
    rows += [(None, "a row without an id but with some words in it", "en"), (None, None, None), (10, rows[10][1], "en"), (10, "the same id and another text", "es")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With further columns whose names the operators use inside."""
    wide = [(*r, "src", None if r[1] is None else len(r[1]), 1, b"x", "y", 2.0) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, rep int, sig binary, kind string, score double").repartition(3)


@pytest.fixture(scope="session")
def labels(spark, rows):
    made = [(i, int("!!" not in (t or "")), int("idiot" in (t or "")), "n") for i, t, _ in rows if i is not None and i < 80]
    return spark.createDataFrame([*made, (None, 1, 1, "n"), (5, None, None, "n")], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
