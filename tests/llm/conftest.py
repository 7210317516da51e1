import os
import random

import pytest

from playseq.llm.tables import on_workers

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    # Names that the operators use themselves.
    "row int, k1 string, k2 string, chunk string, size string, target int, node int, label int, shard int, votes int, stream int, kept string"
)


@pytest.fixture(autouse=True)
def library_on_workers(spark):
    on_workers(lambda s: None)(spark)


def awkward_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, copies, near copies, shared passages."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage, line = words(60), " ".join(words(12))
    base = words(90)
    near = base[:]
    near[5] = "changed"
    texts = [
        (1, " ".join(base), "en", "a"),
        (2, " ".join(base), "en", "b"),
        (3, " ".join(near), "en", "b"),
        (4, None, "de", "a"),
        (5, "", None, None),
        (6, " \t\n ", "de", "c"),
        (7, " ".join(words(40) + passage + words(20)), "fr", "a"),
        (8, " ".join(words(10) + passage) + "\n" + "\n".join([line] * 4), None, "c"),
        (None, " ".join(words(30)), "en", None),
        (None, " ".join(words(30)), None, "a"),
        (9, " ".join(words(50)), "en", "a"),
        (9, " ".join(words(50)), "en", "a"),
        (10, "De " * 300, "fr", "b"),
        (11, "x" * 900, "en", "b"),
        (12, " ".join(words(30_000)), "en", "c"),
        (13, "one", "en", "c"),
        (14, "Two  words", "en", "c"),
        (15, "12 34 !! ##", "en", "c"),
        (16, "Ünïcödé　wide 中文字 " * 60, "es", "a"),
    ]
    texts += [texts[10], texts[10], texts[3], texts[4]]  # repeated in full
    return [(i, t, lang, s, len(t) if t else None, 1, "k", "k", "c", "s", 2, 3, 4, 5, 6, 7, "x") for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
