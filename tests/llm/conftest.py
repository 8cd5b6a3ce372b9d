import random
import re

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copy_id long, size int, h string, score double"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def prose(rng, n):
    return " ".join(
        rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(
            rng.choice(["th", "er", "on", "an", "re", "é", "lo"]) for _ in range(rng.randint(1, 4))
        ) for _ in range(n)
    )


def row(i, text, lang="en", source="s0"):
    """A document with further columns whose names the operators use themselves."""
    return (i, text, lang, source, 1, 7, 7, "h", 0.5)


@pytest.fixture(scope="session")
def docs(spark):
    """Prose with exact and near copies, a repeated id, nulls in any column, empty, blank and very long texts, ties."""
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(3, 120)) for _ in range(60)]
    near = [t.split() for t in texts[:6]]
    rows = [row(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "ü", None])) for i, t in enumerate(texts)]
    rows += [row(100 + i, texts[i]) for i in range(5)] + [
        row(200 + i, " ".join([*w, "zusatz"])) for i, w in enumerate(near)
    ] + [row(300 + i, texts[7] + " x" * i) for i in range(8)]
    rows += [
        row(400, None),
        row(401, ""),
        row(402, " \n\t "),
        row(403, "one"),
        row(403, "one"),
        row(None, texts[3]),
        row(None, "loner " + texts[50]),
        row(404, prose(rng, 9000)),
        row(405, "a" * 30000),
        row(406, "x y z w"),
        row(407, "x y z w"),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def texts(docs):
    """(doc_id, text) of every row."""
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
