import itertools
from collections import Counter

from convoweave.llm.piece_encoding import decode_pieces, encode_pieces
from convoweave.llm.pieces import SPACE, best_path, load_pieces, piece_words
from convoweave.llm.queries import PIECE_MODEL, op4_pieces, op7_token_counts
from convoweave.llm.token_counts import count_tokens, terminal_counts

PIECES = load_pieces(PIECE_MODEL)


def spelled(text):
    """Ids of a whole text, word by word in plain Python."""
    words = piece_words(text.encode() if text is not None else None)
    return list(itertools.chain.from_iterable(best_path(w.decode().replace(" ", SPACE), PIECES) for w in words))


def segmentations(word):
    if not word:
        yield 0.0, []
    for n in range(1, min(PIECES.longest, len(word)) + 1):
        head = word[:n]
        score = PIECES.scores.get(head)
        if score is None and n == 1:
            score = PIECES.unknown
        if score is not None:
            for rest, parts in segmentations(word[n:]):
                yield score + rest, [head, *parts]


def test_best_path_beats_all_segmentations():
    for word in ("▁hello", "▁the", "▁éa日", "▁▁a", "x", "▁ofthest", "\n\n", "▁a\tb"):
        best = max(score for score, _ in segmentations(word))
        ids = best_path(word, PIECES)
        texts = b"".join(PIECES.texts[i] for i in ids).decode().replace(" ", SPACE)
        assert texts == word
        score, i = 0.0, 0
        while i < len(ids):  # bytes of a character without a piece count once
            if ids[i] in PIECES.byte_ids:
                n = len(next(c for c in word if c.encode()[0] == PIECES.texts[ids[i]][0]).encode())
                score, i = score + PIECES.unknown, i + n
            else:
                score, i = score + PIECES.scores[PIECES.texts[ids[i]].decode().replace(" ", SPACE)], i + 1
        assert score == best, word


def test_words_join_to_the_text():
    for text in ("a b", " a", "a  b ", "\n\na\n b", "   ", "\t", ""):
        assert b"".join(piece_words(text.encode())) == ((" " + text).encode() if text else b"")


def test_lattice_equals_plain_viterbi_and_decodes(edges):
    encoded = encode_pieces(edges, PIECE_MODEL)
    assert encoded.columns == [*edges.columns, "ids"]
    rows = decode_pieces(encoded, PIECE_MODEL).collect()
    assert Counter((r.doc_id, r.text, r.n_words) for r in rows) == Counter((r.doc_id, r.text, r.n_words) for r in edges.collect())
    for r in rows:
        assert r.ids == spelled(r.text), (r.text or "")[:50]
        assert r.decoded == (r.text or "")


def test_counts_equal_the_ids(edges):
    rows = count_tokens(edges, PIECE_MODEL, out="n_words").collect()  # a clashing name gives way
    assert len(rows) == edges.count()
    for r in rows:
        assert r.n_words == len(spelled(r.text))


def test_shared_prefixes_are_counted_alike():
    words = sorted({"▁the", "▁then", "▁there", "▁these", "▁t", "x", "xy", "▁日本", "▁日本語"})
    assert terminal_counts(words, PIECES) == [len(best_path(w, PIECES)) for w in words]


def test_queries_agree_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    ids = {r.doc_id: r for r in op4_pieces(spark, sf).collect()}
    counts = {r.doc_id: r.n_tokens for r in op7_token_counts(spark, sf).collect()}
    assert all(r.restored for r in ids.values())
    assert {k: r.n_tokens for k, r in ids.items()} == counts


def test_no_rows_and_null_ids(spark, no_rows):
    assert encode_pieces(no_rows, PIECE_MODEL).count() == 0
    assert count_tokens(no_rows, PIECE_MODEL).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [1, 2])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in decode_pieces(odd, PIECE_MODEL).collect()} == {1: None, 2: "", 3: ""}


def test_lattices_are_grouped_in_small_parts(spark, edges):
    """As many parts as a shuffle has made the edges of 400,000 words spill from each."""
    plan = encode_pieces(edges, PIECE_MODEL)._jdf.queryExecution().executedPlan().toString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "hashpartitioning(word" in plan and f", {8 * parts}), REPARTITION_BY_NUM" in plan
