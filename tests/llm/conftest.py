from __future__ import annotations

import random

import pytest

WORDS = "the of and to in river stone lamp cloud paper table green walk seven night bread glass field moon horse".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n)).replace(". ", ".\n")


@pytest.fixture(scope="session")
def shared(spark):
    """No folder is named here: the operators make a temporary one."""
    return spark


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): prose, copies, near copies, null, empty, blank, one word, very long, other scripts, repeated rows."""
    base = [prose(i, 20 + 7 * i) for i in range(30)]
    rows = list(enumerate(base))
    rows += [(100, base[3]), (101, base[3]), (102, base[25] + " lamp"), (103, base[25].replace("river", "stone", 4)), (104, None), (105, ""), (106, " \n\t "), (107, "word"), (108, prose(99, 30_000)), (109, "ÄÖÜ straße 北京 тест 123 🙂"), (110, "x" * 5000)]
    rows += [(5, base[5])]  # a repeated row
    return rows


@pytest.fixture(scope="session")
def docs(shared, texts):
    """With columns that clash with what operators add."""
    rows = [(i, x, "en", f"s{i % 3}", len(x or ""), -1, "kept") for i, x in texts]
    return shared.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, score string").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
