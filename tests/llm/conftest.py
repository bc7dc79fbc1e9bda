"""Small documents with every awkward case."""

from __future__ import annotations

import random

import pytest

WORDS = "river stone cloud maple ember hollow lantern quiet meadow copper violet harbor thunder willow saffron granite".split()


def prose(n: int, seed: int) -> str:
    chosen = random.Random(seed)
    return " ".join(chosen.choice(WORDS) + str(chosen.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward_texts() -> list[str | None]:
    """Null, empty, blank, marks only, emoji, split characters, long white space, a very long text, copies."""
    long_line = prose(6000, 1)
    return [
        None, "", " ", "\n\n", "?!", "Straße naïve café", "日本語のテキスト", "👩‍👩‍👧 family 🤷🏽", "tab\there  two   spaces\r\nline",
        "It's they'll we've 1234567 x1y2", "a", long_line, long_line, prose(60, 2), prose(60, 2), prose(60, 2) + " tail", "<|endoftext|> <|startoftext|>",
    ]


@pytest.fixture(scope="session")
def awkward(spark, awkward_texts):
    """The awkward texts as documents, with null columns and names that operators might use themselves."""
    rows = [(i, t, None if i % 3 else "en", None, None if t is None else len(t), i, f"p{i}", [i]) for i, t in enumerate(awkward_texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, start long, part_ string, ids array<int>"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
