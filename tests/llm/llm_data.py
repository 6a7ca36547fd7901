"""Texts for the tests: odd cases and invented prose."""

import random

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ran sel tin vor wux zem".split()]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def varied(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


EDGES = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "Ünï çödé 日本語 ﬁ \U0001f600 x"), (6, "a\x00b\x1fc\x85d\u00a0e"),
    (7, "...!!!"), (8, prose(8, 60_000)), (9, "x" * 50_000), (10, " " * 3000 + "end"), (None, "no id here at all"),
    (11, prose(11, 80)), (11, prose(11, 80)), (12, prose(11, 80)), (13, prose(13, 300)),
    (14, varied(prose(13, 300), 1, 0.01)), (15, prose(15, 40) + "\r\n\r\n" + prose(16, 40)), (16, "<|endoftext|> <|ENDOFTEXT|> it's DON'T"),
]
