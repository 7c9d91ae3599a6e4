"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios, trained on labelled text.

Features are the 3- to 6-grams of lower-cased words with a space on either side, told apart by 64-bit hashes (cells), present or absent.
Document counts of each cell in toxic and clean training texts give its log-count ratio; cells whose two rates differ by Z_LEAST
standard errors are kept, all of them. A logistic regression with an L2 penalty is then fitted
on the ratios of the cells present. The fit takes about MAX_TRAIN labelled ids, chosen by a hash (all, if there are fewer), and
one whole text of each, so what it gathers is bounded; scoring covers every row.

Nulls and odd input: a null or blank text has no features and scores the model's intercept; rows whose label is null don't
train; ids labelled twice count as toxic if either is; an id with several rows trains by its least text, once, and scores as rows; with one class or none the score is
the smoothed rate; columns of the input are kept, but one named score is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm._common import checkpointed, small_batches, with_arrow

#: BITS of a cell lead to the few that may be features.
BITS, ORDERS = 20, (3, 4, 5, 6)
MAX_TRAIN = 12_000
Z_LEAST, LEAST_DOCS, ALPHA, L2, STEPS, RATE = 5.0, 3, 1.0, 1e-4, 400, 0.05
THRESHOLD = 0.7
_MUL, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def cells(text: str | None) -> np.ndarray:
    """Cells of the text's n-grams, with repeats."""
    padded = " " + " ".join((text or "").lower().split()) + " "
    c = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = c == 32
    h, inner, out = c.copy(), None, []
    with np.errstate(over="ignore"):
        for n in range(2, ORDERS[-1] + 1):
            if len(c) < n:
                break
            h = h[:-1] * _MUL + c[n - 1 :]
            if n > 2:  # no blank but at the ends
                inner = blank[1 : 2 - n or None] if inner is None else inner[:-1] | blank[n - 2 : -1]
            if n in ORDERS:
                out.append(h[~inner] * _MIX)
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


@dataclass
class Model:
    """A score is the logistic of bias plus the weights of the cells present. Cells rise."""

    bias: float
    cells: np.ndarray
    weights: np.ndarray

    def lookup(self) -> np.ndarray:
        """Whether a feature begins with these bits."""
        out = np.zeros(1 << BITS, bool)
        out[_head(self.cells)] = True
        return out


def _head(found: np.ndarray) -> np.ndarray:
    return (found.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)


def present(text: str | None, model: Model, lookup: np.ndarray) -> np.ndarray:
    """Features in the text, each once."""
    found = cells(text)
    found = np.unique(found[lookup[_head(found)]])
    at = np.searchsorted(model.cells, found)
    return at[(at < len(model.cells)) & (model.cells[np.minimum(at, len(model.cells) - 1)] == found)] if len(model.cells) else at[:0]


def score(text: str | None, model: Model, lookup: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(model.bias + model.weights[present(text, model, lookup)].sum(), -500, 500))))


def training_rows(docs: DataFrame, labels: DataFrame, use: Column, most: int = MAX_TRAIN) -> DataFrame:
    """(toxic, text) of about ``most`` labelled ids at most for which use holds, a row each. The ids of the choice are few enough to broadcast."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(use).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, most / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = [np.unique(cells(t)) for t in batch.column(1).to_pylist()]
        toxic = np.repeat(np.array([x != 0 for x in batch.column(0).to_pylist()], bool), [len(x) for x in each])
        found, at = np.unique(np.concatenate([np.empty(0, np.int64), *each]), return_inverse=True)
        p, n = np.bincount(at[toxic], minlength=len(found)), np.bincount(at, minlength=len(found))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n - p, pa.int64()), pa.array(p, pa.int64())], ["cell", "clean", "toxic"])


def fit(rows: DataFrame) -> Model:
    """rows: (toxic, text), bounded as by ``training_rows``."""
    small_batches(rows.sparkSession)
    rows = checkpointed(rows).coalesce(8)
    total = rows.agg(F.count(F.when(F.col("toxic") != 0, 1)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    n1, n0 = total.t, total.n - total.t
    prior = (n1 + 0.5) / (n1 + n0 + 1)
    empty = Model(float(np.log(prior / (1 - prior))), np.empty(0, np.int64), np.empty(0))
    if not n1 or not n0:
        return empty
    counts = rows.mapInArrow(_counts, "cell long, clean long, toxic long").groupBy("cell").agg(F.sum("clean").alias("q"), F.sum("toxic").alias("p"))
    pooled = (F.col("p") + F.col("q")) / (n1 + n0)
    z = F.abs(F.col("p") / n1 - F.col("q") / n0) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    clear = counts.where(F.col("p") + F.col("q") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") >= Z_LEAST)
    kept = sorted(clear.collect(), key=lambda r: r.cell)
    if not kept:
        return empty
    cell = np.array([r.cell for r in kept], np.int64)
    p, q = np.array([r.p for r in kept]) + ALPHA, np.array([r.q for r in kept]) + ALPHA
    ratio = np.log((p / (n1 + 2 * ALPHA)) / (q / (n0 + 2 * ALPHA)))
    model = Model(0.0, cell, ratio)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = model.lookup()
        for batch in batches:
            found = [present(t, model, lookup).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"])

    got = rows.mapInArrow(features, "toxic int, found array<int>").toArrow()
    y = (got["toxic"].to_numpy() != 0).astype(float)
    found = got["found"].combine_chunks()
    col = found.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(y)), found.value_lengths().to_numpy())
    bias, w = _logistic(row, col, ratio[col], y, len(cell))
    return Model(bias, cell, w * ratio)


def _logistic(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, width: int) -> tuple[float, np.ndarray]:
    """Adam on the mean log loss plus L2, from nought: the same result for the same rows."""
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, STEPS + 1):
        margin = w[-1] + np.bincount(row, value * w[col], len(y))
        off = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y) / len(y)
        g = np.append(np.bincount(col, value * off[row], width) + L2 * w[:-1], off.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return float(w[-1]), w[:-1]


def scored(docs: DataFrame, model: Model, text_col: str = "text", drop: bool = False) -> DataFrame:
    """docs with score; its other columns pass through, the text too unless drop is set."""

    def work() -> Callable[[pa.Array], list[pa.Array]]:
        lookup = model.lookup()
        return lambda texts: [pa.array([score(t, model, lookup) for t in texts.to_pylist()], pa.float64())]

    return with_arrow(docs, text_col, work, StructType([StructField("score", DoubleType())]), drop)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the training folds: rows whose crc32(doc_id) mod 3 is not 1."""
    return fit(training_rows(docs, labels, fold(F.col("doc_id")) != 1))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of op2. A null doc_id is in no fold, so not held out."""
    out = scored(docs.select("doc_id", "text"), trained(docs, labels), drop=True)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
