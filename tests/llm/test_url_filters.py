import random
import re

import pytest

from convoweave.llm.queries import SITE_RULES, SPAM_RULES
from convoweave.llm.url_filters import GlobMasks, Rule, filter_urls

URLS = [
    None, "", "no scheme", "://", "http://", "http://Example.COM/en/1?x=/es/", "https://www.example.com/en/", "https://a.www.example.com/en/x",
    "http://com/", "http://com", "http://evil/x.com/", "http://notexample.com/en/", "ftp://x.net/es/a#b", "http://x.net/esp/", "http://x.net#/es/",
    "http://www.spam-farm.org/", "a://b://c.net/fr/", "http://ÜX.com/é/" + "y" * 5000, "http://q.net/fr/" + "/" * 300, "\n http://a\nb.net/es/\n",
]


def plain(url):
    """Host, path, rule and verdict by the words of the contract."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule in SITE_RULES:
        h, p = rule.label.split("/", 1)
        fits = (host == h or host.endswith("." + h)) and path.startswith("/" + p)
        if fits and (best is None or len(rule.label) > len(best.label)):
            best = rule
    spam = any(r.glob.strip("*") in host for r in SPAM_RULES)
    return host, path, best and best.label, best.verdict if best else "block" if spam else "allow"


def test_rules_as_in_the_contract(spark):
    rng = random.Random(1)
    urls = URLS + [
        rng.choice(["http://", "HTTPS://"]) + rng.choice(["", "www.", "m.www."]) + rng.choice(["example", "casino-x", "y"])
        + rng.choice([".com", ".net", ".org", ".NET"]) + rng.choice(["", "/", "/en/", "/es/1", "/fr", "/fr/?q"]) for _ in range(300)
    ]
    df = spark.createDataFrame([(i, u, "kept", "old") for i, u in enumerate(urls)], "page_id bigint, url string, note string, verdict string")
    out = {r.page_id: r for r in filter_urls(df, SITE_RULES + SPAM_RULES).collect()}
    assert len(out) == len(urls)
    for i, u in enumerate(urls):
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == plain(u), u
        assert out[i].note == "kept" and out[i].url == u


def test_masks_equal_regular_expressions():
    rng = random.Random(2)
    alphabet = "ab./"
    globs = ["".join(rng.choice("ab./*?") for _ in range(rng.randint(1, 9))) + "a" for _ in range(60)] + ["**a**b*", "a" * 70, "*" + "ab" * 40 + "**"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["a" * 70, "x/" + "ab" * 40 + "/q", "b" + "ab" * 40]
    found = GlobMasks(globs).match([t.encode() for t in texts])
    for k, glob in enumerate(globs):
        parts = re.split(r"(\*+|\?)", glob)
        pattern = "".join("[^/]*" if p == "*" else ".*" if p.startswith("*") else "." if p == "?" else re.escape(p) for p in parts)
        for i, text in enumerate(texts):
            assert found[i, k] == bool(re.fullmatch(pattern, text, re.S)), (glob, text)


def test_first_of_equal_rules_holds_and_no_rules_allow(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    rules = [Rule("**a**", "block", "one"), Rule("**com**", "allow", "two")]
    assert filter_urls(df, rules).first()["rule"] == "one"
    assert filter_urls(df, []).first()["verdict"] == "allow"
    assert filter_urls(df.where("false"), rules).count() == 0


def test_a_glob_needs_a_character():
    with pytest.raises(ValueError):
        GlobMasks(["***"])


def test_columns_of_the_caller_stay(spark):
    df = spark.createDataFrame([(1, "http://a.com/x", "h", "p", "v")], "page_id int, url string, _host string, _path string, verdict string")
    (row,) = filter_urls(df, []).collect()
    assert row.asDict() == {
        "page_id": 1, "url": "http://a.com/x", "_host": "h", "_path": "p", "host": "a.com", "path": "/x", "rule": None, "verdict": "allow",
    }
