import random

import pytest

from tessera.llm import session

SCHEMA = "doc_id long, text string, piece int, Text_ string, node double"


@pytest.fixture(autouse=True)
def few_pieces(monkeypatch):
    monkeypatch.setattr(session, "pieces", lambda docs: 8)


def sentence(draw, n):
    return " ".join(draw.choice(["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "la|mbda", "mu"]) + draw.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, shared passages, odd and missing texts."""
    draw = random.Random(5)
    base = [sentence(draw, draw.choice([3, 20, 60, 150])) for _ in range(40)]
    passage = sentence(draw, 45)
    out = [*base, *base[:6], base[4], base[4], base[4]]
    for k in range(12):
        words = base[7 + k % 3].split()
        words[draw.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    out += [f"{sentence(draw, 9)}\n{passage}\n{sentence(draw, 5)}" for _ in range(4)]
    out += ["", None, " \n\t ", "one", "one", "x" * 300, "no break 中文 words", "a\n\na\nb\n a", "\x00nul \x1f", "tail <|endoftext|> here"]
    return out


@pytest.fixture(scope="session")
def rows(texts):
    """Ids out of order, one missing, and a repeated row."""
    ids = list(range(len(texts)))
    random.Random(6).shuffle(ids)
    out = [(i, t) for i, t in zip(ids, texts)]
    return [*out, (None, "a row without id " + texts[0]), out[3]]


@pytest.fixture
def docs(spark, rows):
    """The rows in a table with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in rows], SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
