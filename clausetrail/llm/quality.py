"""Quality of texts by a regularised quadratic discriminant on transformed document statistics.

Each whole text becomes a few statistics (lengths, shares of kinds of characters, repetition), each
transformed so that a class is roughly normal.  Both classes get a mean and a covariance matrix, shrunk
towards the pooled matrix and its diagonal; their Cholesky factors are computed once.  A score is
the logistic of the difference of the two log densities plus the log of the class shares, so the squared
Mahalanobis distances to both classes decide.

Statistics of a class are sums over all labelled rows that are not held out, gathered by grouped sums (one
row per pair of statistics), however many rows there are.

Defined results: a null text is an empty text and has a score; a null ``doc_id`` is not held out and has
no label; labels other than 0 and 1 are left out, a document with several labels counts once for each;
without labels of both classes every score is 0.5; rows with equal ``doc_id`` each get a result; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausetrail.llm.common import prepare, stage, text_bytes

FOLDS = 5
THRESHOLD = 0.3
# Kinds of bytes, as disjoint ranges of ASCII; bytes from 0x80 on are parts of letters.
_SENTENCE = b".,;:?'\"()-"
_KINDS = {
    "letters": bytes([*range(0x61, 0x7B), *range(0x80, 0x100)]),
    "upper": bytes(range(0x41, 0x5B)),
    "digits": bytes(range(0x30, 0x3A)),
    "lines": b"\n",
    "blanks": b" \t\r\x0b\x0c",
    "sentence": _SENTENCE,
    "symbols": bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b not in _SENTENCE),
}
_MASKS = np.stack([np.isin(np.arange(256), list(kind)) for kind in _KINDS.values()]).astype(np.float64)
FEATURES = (
    "log_bytes",
    "upper",
    "digits",
    "lines",
    "blanks",
    "sentence",
    "symbols",
    "word_length",
    "distinct_words",
    "distinct_lines",
    "entropy",
    "common_word",
    "repeated_pairs",
)


def statistics(data: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float64)
    total = counts.sum()
    letters, upper, digits, lines, blanks, sentence, symbols = _MASKS @ counts
    words = data.lower().split()
    n = len(words)
    rows = [row for row in data.split(b"\n") if row]
    pairs = len(set(zip(words, words[1:])))
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    used = counts[counts > 0] / max(total, 1.0)
    shares = np.array([upper, digits, lines, blanks, sentence, symbols])
    logits = np.log((shares + 0.5) / (total - shares + 0.5))
    return [
        float(np.log1p(total)),
        *logits.tolist(),
        float(np.log1p((total - blanks - lines) / max(n, 1))),
        float(np.log((len(seen) + 0.5) / (n - len(seen) + 0.5))),
        float(np.log((len(set(rows)) + 0.5) / (len(rows) - len(set(rows)) + 0.5))),
        float(-(used * np.log2(used)).sum()),
        float(np.log((max(seen.values(), default=0) + 0.5) / (n + 1.0))),
        float(np.log((pairs + 0.5) / (max(n - 1, 0) - pairs + 0.5))),
    ]


def _statistics_column(text: str = "text") -> Column:
    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(x.as_py()) for x in texts], pa.list_(pa.float64()))

    return stats.asNondeterministic()(text_bytes(text))


def fold(doc_id: str = "doc_id") -> Column:
    """Fold 0 is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of x and of products of two statistics (with 1 as one more), by class."""
    for batch in batches:
        quality = batch.column(0).to_numpy()
        rows = np.array(batch.column(1).to_pylist()).reshape(len(quality), len(FEATURES))
        rows = np.column_stack([np.ones(len(rows)), rows])
        for value in np.unique(quality).tolist():
            own = rows[quality == value]
            sums = (own.T @ own).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sums), value, np.int32)), pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)],
                names=["quality", "place", "total"],
            )


class Discriminant:
    """Means, Cholesky factors and log shares of both classes."""

    def __init__(self, moments: dict[int, np.ndarray], pooled: float = 0.5, diagonal: float = 0.05):
        n = {k: m[0, 0] for k, m in moments.items()}
        means = {k: m[0, 1:] / n[k] for k, m in moments.items()}
        spreads = {k: m[1:, 1:] / n[k] - np.outer(means[k], means[k]) for k, m in moments.items()}
        total = sum(n.values())
        common = sum(n[k] / total * s for k, s in spreads.items())
        self.classes = {}
        for k, own in spreads.items():
            own = (1 - pooled) * own + pooled * common
            own = (1 - diagonal) * own + diagonal * np.diag(np.diag(own)) + 1e-6 * np.eye(len(own))
            factor = np.linalg.cholesky(own)
            self.classes[k] = (means[k], factor, np.log(n[k] / total) - np.log(np.diag(factor)).sum())

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if set(self.classes) != {0, 1}:
            return np.full(len(rows), 0.5)
        density = {}
        for k, (mean, factor, constant) in self.classes.items():
            far = np.linalg.solve(factor, (rows - mean).T)
            density[k] = constant - 0.5 * (far * far).sum(0)
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(features: DataFrame, labels: DataFrame) -> Discriminant:
    """features: doc_id and x.  Learns from all labelled rows outside the held-out fold."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = features.filter(F.col("doc_id").isNotNull() & (fold() != 0)).join(known, "doc_id").select("quality", "x")
    sums = rows.mapInArrow(_moments, "quality int, place int, total double").groupBy("quality", "place").agg(F.sum("total").alias("total"))
    side = len(FEATURES) + 1
    moments: dict[int, np.ndarray] = {}
    for row in sums.collect():  # two classes of (13 + 1) ** 2 sums
        moments.setdefault(row["quality"], np.zeros(side * side))[row["place"]] = row["total"]
    return Discriminant({k: m.reshape(side, side) for k, m in moments.items()})


def _score_column(model: Discriminant, x: Column) -> Column:
    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        flat = rows.values.to_numpy(zero_copy_only=False) if rows.offset == 0 else np.array(rows.to_pylist())
        return pa.array(model.scores(np.asarray(flat, np.float64).reshape(len(rows), len(FEATURES))))

    return score.asNondeterministic()(x)


def _text_score_column(model: Discriminant, text: str = "text") -> Column:
    """Statistics and score in one step, so that a task needs one Python worker."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        rows = np.array([statistics(x.as_py()) for x in texts], np.float64).reshape(len(texts), len(FEATURES))
        return pa.array(model.scores(rows), pa.float64())

    return score.asNondeterministic()(text_bytes(text))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    prepare(docs.sparkSession)
    features = stage(docs.select("doc_id", _statistics_column().alias("x")), "statistics")
    scored = features.select("doc_id", _score_column(fit(features, labels), F.col("x")).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(fold() == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose score reaches the threshold; columns stay.

    Statistics are taken once for the fit (without texts, these are small) and once more while
    documents pass by, so no text is moved between tasks.
    """
    prepare(docs.sparkSession)
    features = stage(docs.select("doc_id", _statistics_column().alias("x")), "statistics")
    model = fit(features, labels)
    scored = docs.select(F.struct("*").alias("doc"), _text_score_column(model).alias("score"))
    return scored.filter(F.col("score") >= THRESHOLD).select("doc.*")
