"""Globs against ``fnmatch``."""

import fnmatch
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from convoweave.functions import globs
from convoweave.functions.status import UPLOAD_IGNORE, is_artifact, is_ignored_upload

PATTERNS = [
    "checkpoint-*", "slurm/**", "*.bin", "a?c", "[abc]*", "[!abc]*", "[a-c]x", "[]]", "[!]]", "[", "[]", "[!]", "a[b", "*[", "",
    "*", "**", "?", "??", "[z-a]", "[!z-a]", "x[a-]y", "x[-a]y", "[\\]x", "a.b", "a+b", "(a|b)", "^a$", "{a}", "a\\b", "[^a]", "[&&a]",
    "[a-c-e]", "é*", "*😀", "a*b*c", "*a*a*a*b", "[[]x", "[!a-c]?[0-9]", "\n*", "A*",
]
PATHS = [
    "checkpoint-1", "checkpoint-1/a.bin", "checkpoint", "xcheckpoint-1", "slurm/a/b", "slurm", "slurm/", "abc", "a\nc", "ac", "bx", "dx", "]", "[", "[]",
    "", "x", "x-y", "xay", "\\x", "a.b", "axb", "a+b", "(a|b)", "a", "b", "^a$", "{a}", "a\\b", "^", "&", "e", "-", "été", "x😀", "aXbYc", "aaab", "aaaaab", "[x",
    "zz9", "\nq", "ABC", "!", "é", "a[b", "!]",
]


def test_every_path_and_pattern(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    found = df.select("path", *[globs.matches_any(F.col("path"), [p]).alias(f"p{i}") for i, p in enumerate(PATTERNS)]).collect()
    for row in found:
        for i, pattern in enumerate(PATTERNS):
            assert row[f"p{i}"] == fnmatch.fnmatchcase(row.path, pattern), (row.path, pattern)


def test_random_patterns(spark):
    rng = random.Random(4)
    # Not after a range that runs backwards: there fnmatch takes an exclamation mark for the sign of a negated set.
    patterns = ["".join(rng.choice([*"ab*?[]!/", "a-b", "-/"]) for _ in range(rng.randint(1, 8))) for _ in range(150)]
    patterns = [p for p in patterns if not re.search(r"\[(b-a|/-|b-/|a-/)", p)]
    paths = ["".join(p) for n in range(4) for p in itertools.product("ab/-", repeat=n)]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    found = df.select("path", F.array(*[globs.matches_any(F.col("path"), [p]) for p in patterns]).alias("hits")).collect()
    for row in found:
        assert row.hits == [fnmatch.fnmatchcase(row.path, p) for p in patterns]


def test_lists_are_one_alternation(spark):
    df = spark.createDataFrame([("a.bin",), ("b/c.pt",), ("d",), (None,)], "path string")
    hits = [r[0] for r in df.select(globs.matches_any(F.col("path"), ["*.bin", "b/*", "b/*"])).collect()]
    assert hits == [True, True, False, False]
    assert [r[0] for r in df.select(globs.matches_any(F.col("path"), [])).collect()] == [False] * 4


def test_many_stars_end(spark):
    df = spark.createDataFrame([("a" * 4000,)], "path string")
    assert df.select(globs.matches_any(F.col("path"), ["*a" * 40 + "*b"])).first()[0] is False


def test_pattern_tables(spark, monkeypatch):
    table = spark.createDataFrame([("a*",), ("a*",), (None,), ("b",)], "pattern string")
    assert globs.table_patterns(table) == ["a*", "b"]
    monkeypatch.setattr(globs, "MAX_PATTERNS", 1)
    with pytest.raises(ValueError, match="more than 1"):
        globs.table_patterns(table)


def test_upload_and_artifact_rules(spark):
    df = spark.createDataFrame([("checkpoint-1/x",), ("slurm/a/b.sh",), ("logs/x",), ("logs",), ("model.bin",)], "p string")
    ignored = df.select(is_ignored_upload(F.col("p")), is_ignored_upload(F.col("p"), ["logs/", "m?del*"]), is_artifact(F.col("p"), ["*.b[a-z]n"])).collect()
    assert [tuple(r) for r in ignored] == [
        (True, False, False), (True, False, False), (False, True, False), (False, False, False), (False, True, True),
    ]
    assert UPLOAD_IGNORE == ("checkpoint-*", "slurm/**")
