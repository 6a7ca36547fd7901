"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed byte n-grams (letters only, A to Z folded),
normalised to length 1. Each language has several centroids, from spherical
k-means over its training vectors, and a text takes the language of the centroid
with the largest cosine. A text that is farther from all centroids than nearly all
training texts were, by a margin, is rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, StringType, StructField

from .batches import append_columns, raw_texts

UNDETERMINED = "und"
ORDERS = (2, 3)
BINS = 4096

# Bytes that are no letters become one space-like byte; non-ASCII bytes stay.
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass(frozen=True)
class LanguageModel:
    """What prediction needs: a few vectors, whatever the corpus was."""

    languages: tuple[str, ...]
    idf: np.ndarray  # [bins]
    centroids: np.ndarray  # [centroid, bins], rows of length 1
    owner: np.ndarray  # language number of each centroid
    floor: float  # smallest cosine that is accepted


def has_letter(raw: bytes | None) -> bool:
    if not raw:
        return False
    return bool(_ASCII_LETTER.search(raw)) or (
        not raw.isascii() and any(map(str.isalpha, raw.decode("utf-8", "replace")))
    )


def ngram_counts(texts: list[bytes | None], bins: int = BINS) -> np.ndarray:
    """Counts of hashed n-grams, one row per text. Whole texts, in pieces of fixed size."""
    out = np.zeros((len(texts), bins), np.float32)
    step = 1 << 20
    for i, raw in enumerate(texts):
        for at in range(0, len(raw or b""), step):
            # Pieces overlap so that no n-gram is lost or counted twice.
            piece = raw[at : at + step + max(ORDERS) - 1]
            lead = b" " if at == 0 else b""
            a = np.frombuffer(lead + piece.translate(_LETTERS), np.uint8).astype(np.uint32)
            for n in ORDERS:
                size = min(len(a) - n + 1, step + len(lead))
                if size <= 0:
                    continue
                code = a[:size]
                for k in range(1, n):
                    code = (code << np.uint32(8)) | a[k : k + size]
                hashed = (code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(20)
                out[i] += np.bincount(hashed % bins, minlength=bins).astype(np.float32)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _cluster(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means; starts from points that are far from those taken before."""
    centres = _unit(x.mean(0, keepdims=True))
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(1))]])
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, 1)
        sums = np.stack([x[nearest == j].sum(0) for j in range(len(centres))])
        moved = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def fit_languages(
    labelled: DataFrame,
    *,
    text_col: str = "text",
    label_col: str = "lang",
    sample_rows: int = 2400,
    max_languages: int = 400,
    centroids: int = 4,
    quantile: float = 0.001,
    margin: float = 0.25,
) -> LanguageModel:
    """Fit on about ``sample_rows`` labelled rows, the same share for each language.

    The sample is drawn by text hash (rows with label and letters only), so it does not
    depend on partitions; copies count once. What reaches the driver is one vector per sampled text.
    At most ``max_languages`` labels, the most frequent, are learned. The rejection
    floor is ``margin`` times the ``quantile`` of the sample's own best cosines: low enough
    to keep short clean texts. No usable rows give a model without languages.
    """
    rows = labelled.select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {
        r.lang: r["count"]
        for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    }
    if not counts:
        return LanguageModel((), np.zeros(BINS, np.float32), np.zeros((0, BINS), np.float32), np.zeros(0, int), 0.0)
    languages = tuple(sorted(counts))
    each = max(1, sample_rows // len(languages))
    share = F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(1.0, each / counts[lang]))])
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # Copies of a text are drawn together; one of them is enough, so that the bound holds whatever repeats.
    drawn = rows.where(place < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    distinct = drawn.groupBy("lang", F.xxhash64("text").alias("_copy")).agg(F.first("text").alias("text"))
    sample = append_columns(
        distinct.select("lang", "text"),
        ["text"],
        [StructField("vector", BinaryType())],
        lambda b: [[row.tobytes() for row in ngram_counts(raw_texts(b.column("text")))]],
        text="text",
        keep=["lang"],
    ).collect()
    sample.sort(key=lambda r: (r.lang, bytes(r.vector)))
    counted = np.stack([np.frombuffer(r.vector, np.float32) for r in sample]) if sample else np.zeros((0, BINS), np.float32)
    label = np.array([languages.index(r.lang) for r in sample], int)
    idf = np.log((1 + len(counted)) / (1 + (counted > 0).sum(0))).astype(np.float32) + 1
    vectors = _unit(counted * idf)
    found = [(j, _cluster(vectors[label == j], centroids)) for j in range(len(languages)) if (label == j).any()]
    if not found:
        return LanguageModel((), idf, np.zeros((0, BINS), np.float32), np.zeros(0, int), 0.0)
    centres = np.vstack([c for _, c in found]).astype(np.float32)
    owner = np.concatenate([np.full(len(c), j) for j, c in found])
    best = np.where(owner[None] == label[:, None], vectors @ centres.T, -1).max(1)
    return LanguageModel(languages, idf, centres, owner, float(margin * np.quantile(best, quantile)))


PREDICTION = [
    StructField("lang_pred", StringType()),
    StructField("score", DoubleType()),
    StructField("rejected", BooleanType()),
]


def predict_languages(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents plus ``lang_pred``, ``score`` (the cosine, 0 to 1) and ``rejected``.

    A text that is null or has no letter is ``und`` with score 0 and rejected; any other takes
    the nearest language, and is rejected below the model's floor. Ties go to the language
    that comes first by name. Reads the text only; nothing is shuffled. The
    model is a few hundred centroids, bounded by the fit. Columns with the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batch: pa.RecordBatch) -> list[list]:
        m = shared.value
        texts = raw_texts(batch.column(0).cast(pa.string()))
        names, scores = [], []
        for i in range(0, len(texts), 256):
            part = texts[i : i + 256]
            if len(m.owner):
                cosine = _unit(ngram_counts(part) * m.idf) @ m.centroids.T
                nearest = cosine.argmax(1)
            for j, raw in enumerate(part):
                known = len(m.owner) and has_letter(raw)
                names.append(m.languages[m.owner[nearest[j]]] if known else UNDETERMINED)
                scores.append(float(min(1.0, max(0.0, cosine[j, nearest[j]]))) if known else 0.0)
        return [names, scores, [n == UNDETERMINED or s < m.floor for n, s in zip(names, scores)]]

    return append_columns(docs, [text_col], PREDICTION, predict, text=text_col, keep=keep)


def keep_identified(
    docs: DataFrame, model: LanguageModel, *, text_col: str = "text", unlabelled: str = "keep"
) -> DataFrame:
    """The documents that are not rejected, columns as they came, those named like results included.

    A model that has learned no language rejects only what has no letter (``unlabelled="keep"``), or is an error (``"refuse"``).
    """
    if unlabelled not in ("keep", "refuse"):
        raise ValueError(f"unlabelled must be 'keep' or 'refuse', got {unlabelled!r}")
    names = [f"_{i}" for i in range(len(docs.columns))]
    hidden, text = docs.toDF(*names), names[docs.columns.index(text_col)]
    if not model.languages:
        if unlabelled == "refuse":
            raise ValueError("no usable label: no language was learned")
        return hidden.where(F.col(text).cast("string").rlike(r"\p{L}")).toDF(*docs.columns)
    judged = predict_languages(hidden, model, text_col=text)
    return judged.where(~F.col("rejected")).select(*names).toDF(*docs.columns)
