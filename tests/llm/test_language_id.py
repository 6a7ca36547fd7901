import numpy as np
import pytest

from convoweave.llm.language_id import LanguageModel, fit_languages, keep_identified, ngram_counts, predict_languages
from convoweave.llm.queries import op2_language_id


def test_held_out_documents_are_identified(spark):
    df = op2_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = df.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_odd_texts(spark, edges):
    model = fit_languages(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = predict_languages(edges, model).collect()
    assert len(rows) == edges.count()
    by_text = {r.text: r for r in rows}
    for text in (None, "", "  \n\t ", "...!!!"):
        assert (by_text[text].lang_pred, by_text[text].score, by_text[text].rejected) == ("und", 0.0, True)
    assert by_text["one"].lang_pred in model.languages
    assert by_text["one"].n_words == 7  # other columns are carried
    kept = keep_identified(edges, model)
    assert kept.columns == edges.columns and kept.schema["rejected"].dataType == edges.schema["rejected"].dataType
    assert None not in {r.text for r in kept.collect()}


def test_no_labels_and_no_rows(spark, edges, no_rows):
    model = fit_languages(no_rows)
    assert isinstance(model, LanguageModel) and not model.languages
    assert {r.lang_pred for r in predict_languages(edges, model).collect()} == {"und"}
    assert predict_languages(no_rows, model).count() == 0


def test_long_texts_count_every_ngram_once():
    text = ("abcdefgh " * 300_000).encode()
    whole = ngram_counts([text])[0]
    assert abs(whole.sum() - (2 * (len(text) + 1) - 3)) < 1  # pairs and triples of the text with a space in front


def test_far_texts_are_rejected(spark):
    rows = [(i, "the of and in to is " * 30, "en") for i in range(20)] + [(i + 20, "der die und das ist ein " * 30, "de") for i in range(20)]
    model = fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    odd = spark.createDataFrame([(1, "qzxj vkwq zzqx" * 20)], "doc_id bigint, text string")
    assert predict_languages(odd, model).first()["rejected"]


def test_without_a_language_letters_decide(spark, edges, no_rows):
    model = fit_languages(no_rows)
    kept = {r.text for r in keep_identified(edges, model).collect()}
    assert kept == {r.text for r in edges.collect() if r.text and any(c.isalpha() for c in r.text)}
    with pytest.raises(ValueError, match="label"):
        keep_identified(edges, model, unlabelled="refuse")


def test_nearest_centroid_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fit_languages(docs)
    for r in predict_languages(docs, model).collect():
        counts = ngram_counts([r.text.encode()])[0] * model.idf
        length = np.linalg.norm(counts)
        cosines = [float(counts @ c / (length * np.linalg.norm(c))) for c in model.centroids]
        best = max(cosines)
        assert abs(best - r.score) < 1e-4
        assert r.lang_pred in {model.languages[o] for o, c in zip(model.owner, cosines) if c > best - 1e-5}


def test_a_text_in_a_third_of_the_rows_is_learned_once(spark):
    copies, others = 4000, 200
    rows = [(i, "le la les des un une et est dans " * 20, "fr") for i in range(copies)]
    rows += [(copies + i, f"the of and in to is {i} " * 20, "en") for i in range(others)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    model = fit_languages(df, sample_rows=100_000)
    drawn = spark.createDataFrame([(1, "le la et est une", "x"), (2, "the of and is to", "x")], "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in predict_languages(drawn, model).orderBy("doc_id").collect()] == ["fr", "en"]
    assert (model.owner == model.languages.index("fr")).sum() == 1  # one distinct text is one centroid
