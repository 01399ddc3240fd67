"""Documents with nulls, empty and long texts, repeated rows, odd characters and clashing columns."""

from __future__ import annotations

import random

import pytest

ODD = [
    (1, "One two three four five six seven eight nine ten eleven"),
    (2, "ONE two three four five six seven eight nine ten eleven"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "short text"),
    (7, "Short  Text"),
    (None, "a text without an id, of a few words only"),
    (None, None),
    (8, "line with wide spaces\u0085and breaks ​ end"),
    (9, "日本語の文章 \U0001f600\U0001f600 Привет, мир! café don't I'LL we've"),
    (10, "x" * 30_000),
    (11, " ".join(f"w{i % 977}" for i in range(60_000))),
    (12, "  leading and   trailing \n\n\n spaces\t\t "),
    (13, "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> 12345678901 3.14159 --- == !!! ␟ \x01 mark"),
    (13, "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> 12345678901 3.14159 --- == !!! ␟ \x01 mark"),
    (14, "ab"),
    (-5, "negative id"),
]


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple[int | None, str | None]]:
    return ODD


@pytest.fixture(scope="session")
def odd(spark):
    """With extra columns named as inner ones of the operators are."""
    clash = ["node", "k", "t", "d", "key", "band", "m_text", "m_found", "c0", "items", "print", "start", "label", "n_chars"]
    schema = "doc_id bigint, text string, lang string, " + ", ".join(f"{c} string" for c in clash[:-1]) + ", n_chars bigint"
    return spark.createDataFrame([(d, t, None, *["clash"] * (len(clash) - 1), 7) for d, t in ODD], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def prose():
    """A maker of invented sentences."""
    words = [f"{a}{b}{c}" for a in ("ba", "ke", "mi", "tor", "lun", "sa") for b in ("ra", "ne", "vi", "lo") for c in ("n", "st", "del", "ka", "m")]

    def make(n: int, seed: int) -> str:
        pick = random.Random(seed)
        return " ".join(pick.choice(words) for _ in range(n))

    return make
