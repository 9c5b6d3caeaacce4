import random

import pytest


@pytest.fixture(scope="session")
def vocabulary():
    r = random.Random(11)
    return ["".join(r.choice(["th", "er", "in", "on", "at", "re", "ti", "es", "ou", "ha"]) for _ in range(r.randint(1, 4))) for _ in range(900)]


@pytest.fixture(scope="session")
def prose(vocabulary):
    def make(seed: int, words: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) + ("." if r.random() < 0.1 else "") for _ in range(words))

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, repeated and long texts under ordinary, repeated and null ids."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "word " * 40_000), (None, "no id here"), (6, "ünï çødé 日本 \U0001f600 \x00 ok")]
