import re

from convoweave.llm.decontamination import decontaminate, mark_benchmark, with_contamination
from llm_data import EDGES, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, width=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - width + 1) if v else 0):
            window = v[i : i + width]
            for s in range(len(w) - len(window) + 1):
                if w[s : s + len(window)] == window:
                    hit |= set(range(s, s + len(window)))
                    found |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(found)


ITEMS = [
    (1, prose(13, 300)[700:900]), (2, prose(8, 60_000)[-400:]), (3, "One"), (4, ""), (5, None), (5, "ünï ÇÖDÉ 日本語"), (None, prose(11, 80)[:120]),
    (10, prose(11, 80)[:120].upper()), (10, prose(11, 80)[:120]), (7, "ran ran ran ran ran ran ran ran ran ran ran ran"),
]


def check(spark, edges, **options):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = with_contamination(mark_benchmark(edges, items, **options)).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        if len(r.text or "") > 100_000:
            assert r.n_words == len(words(r.text)) and r.hit_items == ["2"]
            continue
        assert (r.n_words, r.n_hit, r.hit_items) == plain(r.text, ITEMS), (r.text or "")[:60]
        assert r.n_items == len(r.hit_items) and r.contaminated == (r.n_hit > 0)
        assert r.source == "s"


def test_marks_equal_a_plain_search(spark, edges):
    check(spark, edges)


def test_blocks_of_the_benchmark_give_the_same(spark, edges):
    check(spark, edges, windows_per_block=7)


def test_overlapping_hits_are_one_span(spark):
    docs = spark.createDataFrame([(1, "x " + "go " * 15 + "y")], "doc_id bigint, text string")
    items = spark.createDataFrame([("a", "go " * 10), ("b", "y")], "item_id string, text string")
    row = mark_benchmark(docs, items).first()
    assert [(s.start, s.end) for s in row.hit_spans] == [(1, 17)] and row.hit_items == ["a", "b"]


def test_clean_documents_stay_as_they_are(spark, edges, no_rows):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    kept = decontaminate(edges, items)
    assert kept.columns == edges.columns
    dirty = {t for _, t in EDGES if len(t or "") > 100_000 or plain(t, ITEMS)[1]}
    assert sorted(repr(r.text) for r in kept.collect()) == sorted(repr(t) for _, t in EDGES if t not in dirty)
    assert decontaminate(no_rows, items).count() == 0
    assert decontaminate(edges, items.where("false")).count() == len(EDGES)
