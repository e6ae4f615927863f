import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, low int, `drop` int, words string"


def extra(rows):
    """Rows of (doc_id, text) beside columns whose names the operators use themselves."""
    return [(i, t, "en", "s", 1, "node", "key", 3, 4, "words") for i, t in rows]


@pytest.fixture(scope="session")
def documents():
    """A corpus with nulls, blanks, ties, repeated rows, near copies, shared passages and a very long text."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghiklmnoprstuvé") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = text(30), "A common line of some length."
    rows = [(0, None), (1, ""), (2, " \t\n\x0b "), (3, "one two"), (4, "one two"), (5, "ONE two"), (6, "été ÉTÉ ßtraße 漢字 🙂"), (7, "x\n\ny\n"), (None, text(40)), (8, "a a a a a a a a a a a a a a a a a a a a")]
    base = text(120)
    for i in range(10, 40):
        cells = base.split()
        for _ in range(rng.randint(0, 6)):
            cells[rng.randrange(len(cells))] = text(1)
        rows.append((i, " ".join(cells)))
    for i in range(40, 60):
        rows.append((i, f"{text(rng.randint(1, 30))} {passage} {text(10)}\n{line}\n{text(5)}\n  {line.upper()}  "))
    for i in range(60, 80):
        rows.append((i, text(rng.randint(1, 80))))
    rows += [(80, rows[30][1]), (81, rows[30][1]), (81, rows[30][1]), (82, text(6000)), (83, "x" * 30000)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, documents):
    return spark.createDataFrame(extra(documents), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
