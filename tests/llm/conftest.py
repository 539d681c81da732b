"""Documents with every kind of odd row: null and equal ids, null, empty and very long texts, ties, clashing columns."""

from __future__ import annotations

import random

import pytest

#: Names that operators might use themselves.
CLASHES = "row string, version long, size long, list string, class string, n long, h long, k long, gone string, share int, rank double, key string, label int"


@pytest.fixture(scope="session")
def messy_rows() -> list[tuple]:
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(2, 7))) for _ in range(400)] + ["the", "of", "and", "la", "der"] * 20
    sentence = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)) + "."
    line = sentence(12)
    passage = "\n".join(sentence(25) for _ in range(4))
    rows: list[tuple] = [(i, "\n".join(sentence(r.randint(5, 20)) for _ in range(r.randint(1, 8))), r.choice(["s1", "s2", "é", None])) for i in range(40)]
    near = sentence(120).split()
    for i in range(40, 60):
        copy = list(near)
        copy[r.randrange(len(copy))] = f"w{i}"
        rows.append((i, " ".join(copy), "s1"))
    rows += [(60 + i, sentence(30) + "\n" + passage + "\n" + sentence(30) + "\n" + line, "s2") for i in range(5)]
    rows += [(70, None, "s1"), (71, "", None), (72, " \n\t ", "s1"), (73, "one", "s2"), (74, "one", "s2"), (75, "a b c d", "s1")]
    rows += [(80, passage, "s1"), (80, passage, "s1"), (80, sentence(40), "s1"), (None, passage, "s3"), (None, sentence(30), None), (None, None, None)]
    rows += [(90, "x" * 3000, "s1"), (91, ("ab\n" * 2000), "s2"), (92, " ".join(vocabulary * 60), "s1"), (93, line + "\n" + line + "\n" + line + "\n" + line, "s1")]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """doc_id, text, lang, source, n_chars and columns whose names operators might use."""
    extra = [c.split() for c in CLASHES.split(", ")]
    values = {"string": "x", "long": 7, "int": 3, "double": 1.5}
    data = [(d, t, None, s, None if t is None else len(t), *(values[k] for _, k in extra)) for d, t, s in messy_rows]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}").repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
