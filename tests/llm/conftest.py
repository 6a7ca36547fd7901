import pytest

pytest.importorskip("convoweave.llm")

from llm_data import EDGES  # noqa: E402


@pytest.fixture(scope="session")
def edges(spark):
    """Documents with every odd case, and columns named like what operators make."""
    rows = [(i, t, "en", "s", None, 7, "x", True) for i, t in EDGES]
    return spark.createDataFrame(
        rows,
        "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, hit_items string, rejected boolean",
    ).repartition(3)


@pytest.fixture(scope="session")
def no_rows(edges):
    return edges.where("false")
