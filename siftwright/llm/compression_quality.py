"""Quality by compression: zstandard dictionaries of good and of bad text.

A text is compressed in pieces with either dictionary; the difference of the compressed sizes, normalised by the
larger one, is calibrated to a probability on labelled rows that neither dictionary has seen. The calibration also gets
the better compressed size over the plain one (at three scales): it tells repetitive texts, which either dictionary
makes equally short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of
from .fitting import fit_logistic, fold, label_counts, logistic, marked, sample, texts_of_sample

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: The bounded samples: documents of each label for its dictionary, their longest text, those for calibration.
DICTIONARY_DOCS, DICTIONARY_BYTES, CALIBRATION_DOCS = 1500, 20_000, 4000
DICTIONARY_SIZE, PIECE = 65_536, 1024


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]


def train_dictionaries(texts: list[list[bytes]]) -> list[bytes]:
    """A dictionary of the pieces of each list of texts, all made alike: trained, or of very few or too uniform texts their own last bytes."""
    pieces = [[p for t in own for i in range(0, len(t), PIECE) if len(p := t[i : i + PIECE]) > 64] for own in texts]
    if min(sum(map(len, own)) for own in pieces) > 5 * DICTIONARY_SIZE:
        try:
            return [zstandard.train_dictionary(DICTIONARY_SIZE, own, k=256, d=8, level=3).as_bytes() for own in pieces]
        except zstandard.ZstdError:  # too uniform for it
            pass
    size = min(DICTIONARY_SIZE, *(sum(map(len, own)) for own in texts))
    return [b"".join(own)[-size:] if size else b"" for own in texts]


class Sizes:
    """Features of a text from its compressed sizes."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (good, bad)]

    def features(self, text: bytes | None) -> list[float]:
        if not text:
            return [1.0, 0.0, 0.0, 0.0, 0.0]
        a, b = (sum(len(c.compress(text[i : i + PIECE])) for i in range(0, len(text), PIECE)) for c in self.both)
        ratio = min(a, b) / len(text)
        return [1.0, 10 * (b - a) / max(a, b), 5 * ratio, 10 * min(ratio, 0.3), 20 * min(ratio, 0.15)]


def _features(good: bytes, bad: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for b in batches:
            x = [sizes.features(t) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("label")), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on bounded samples of labelled rows outside the held-out fold: folds 1 and 2 give the dictionaries, 3 and 4 the calibration."""
    marks = marked(labels, "quality", FOLDS, HELD_OUT)
    own = marks.where(fold("id", FOLDS) <= 2)
    both = texts_of_sample(docs, sample(own, 1, DICTIONARY_DOCS).union(sample(own, 0, DICTIONARY_DOCS)), "dictionary")
    both = both.where(F.octet_length("text").between(1, DICTIONARY_BYTES)).collect()
    good, bad = train_dictionaries([[r.text.encode() for r in both if r.label == k] for k in (1, 0)])
    rest = marks.where(fold("id", FOLDS) > 2)
    counts = label_counts(rest)
    rest = texts_of_sample(docs, sample(rest, 1, CALIBRATION_DOCS).union(sample(rest, 0, CALIBRATION_DOCS)), "calibration")
    got = rest.mapInArrow(_features(good, bad), "label int, x array<double>").collect()
    x, y = np.array([r.x for r in got], float), np.array([r.label for r in got], float)
    return Model(good, bad, fit_logistic(x, y, counts))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        sizes = Sizes(m.good, m.bad)
        for b in batches:
            p = [logistic(sizes.features(t), m.weights) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a score of 0 to 1: the probability that a text's quality label is 1.

    Reads the whole text and nothing else. Null and empty texts get the score of no evidence from their size.
    Columns of ``docs`` come back as they are; one named ``score`` is replaced. An empty table stays empty.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_score(known), f"{kinds}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each document, by a model of the rows that aren't held out.

    A row with a null doc_id is held out of nothing (held_out is false) and is scored like any other.
    """
    model = train(docs, labels)
    out = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return out.select(
        "doc_id",
        F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
