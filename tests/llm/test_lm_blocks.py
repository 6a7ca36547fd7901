import math

from convoweave.llm import lm_scoring
from convoweave.llm.lm_scoring import count_pairs, score_texts
from llm_data import EDGES, prose


def test_blocks_of_the_filter_add_up_and_drop_no_pair(spark):
    rows = [(i % 50, prose(i % 60, 40), i % 5 == 1) for i in range(150)] + [(k, t, False) for k, t in EDGES if len(t or "") < 10_000]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, held boolean").repartition(3)
    pairs = count_pairs(df.where("not held"))
    total = pairs.width(2) * pairs.segments
    assert pairs.per_level[2] > 0 and total > 1000

    def scored(**options):
        found = score_texts(df, "held", **options)
        assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return sorted(found.collect(), key=lambda r: (repr(r.doc_id), r.held_out, r.n_tokens, r.base_score, r.score))

    # A block may hold a third of the filter: pairs seen twice count as they do in the whole.
    whole, parts = scored(), scored(block_bytes=total // 3)
    assert len(whole) == len(parts) == len(rows)
    for a, b in zip(whole, parts):
        assert a[:6] == b[:6] and math.isclose(a.score, b.score, rel_tol=1e-9)


def test_counted_pairs_stay_counted(spark):
    texts = spark.createDataFrame([(prose(i % 60, 40),) for i in range(120)], "text string")
    pairs = count_pairs(texts)
    assert pairs.least == 2 and pairs.width(2) * pairs.segments * 8 >= 10 * pairs.entries(2)
    assert lm_scoring.build_filter(texts).bits.nbytes == pairs.width(2) * pairs.segments
