"""Document quality by a linear-chain conditional random field over lines.

Every line of a document is good or bad.  Its features come from the line and its neighbours; the
chain adds weights for staying or changing between lines.  Training labels all lines of a document
with the document's label and maximises the conditional likelihood.  A document's score is the
mean marginal of "good" from the forward-backward pass, weighted by line length.

Features are counted on the raw bytes of a whole batch at once.  Scoring is one pass over the
texts without a shuffle.  Labels, language, source and id are never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import ship, slices
from graphloom.storage import StageTables

# Bounds of the training sample: documents, and lines of all of them together.
SAMPLE_ROWS = 6000
SAMPLE_LINES = 400_000

_KINDS = ("upper", "lower", "digit", "space", "stop", "pause", "shout", "bar", "mark", "high")


def _kind_table() -> np.ndarray:
    kinds = np.full(256, _KINDS.index("mark"), np.int8)
    for name, members in (
        ("upper", range(65, 91)),
        ("lower", range(97, 123)),
        ("digit", range(48, 58)),
        ("space", [9, 10, 11, 12, 13, 32]),
        ("stop", b".?"),
        ("pause", b",;:'-"),
        ("shout", b"!"),
        ("bar", b"|"),
        ("high", range(128, 256)),
    ):
        kinds[list(members)] = _KINDS.index(name)
    return kinds


_KIND = _kind_table()


@dataclass
class Lines:
    """Lines of a batch: per line its features, weight (bytes + 1) and document."""

    features: np.ndarray
    weight: np.ndarray
    counts: np.ndarray  # lines per document


def _between(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind=np.int64) -> np.ndarray:
    total = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=total[1:], dtype=kind)
    return total[ends] - total[starts]


def describe(texts: list[bytes | None], pairs: np.ndarray | None) -> Lines:
    """Features of every line of whole texts.

    pairs: log odds of each byte pair (65536 values) between good and bad text, or None.
    """
    texts = [t or b"" for t in texts]
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    last = np.cumsum(sizes)
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([last - sizes, breaks + 1]))
    ends = np.sort(np.concatenate([breaks, last]))
    counts = 1 + np.searchsorted(breaks, last) - np.searchsorted(breaks, last - sizes)
    size = (ends - starts).astype(np.float64)
    kind = _KIND[data]
    n = {name: _between(kind == i, starts, ends) for i, name in enumerate(_KINDS)}
    solid = kind != _KINDS.index("space")
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    # A word starts after white space or at the start of a text.
    opens[(last - sizes)[sizes > 0]] = solid[(last - sizes)[sizes > 0]]
    words = _between(opens, starts, ends).astype(np.float64)
    ink = np.maximum(size - n["space"], 1)
    some = np.maximum(words, 1)
    # Repetition: of words in the line, of words of the line before, of the line in its document.
    fresh, echo, again = np.ones(len(size)), np.zeros(len(size)), np.zeros(len(size))
    at = 0
    for text in texts:
        before: set[bytes] = set()
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            parts = line.split()
            own = set(parts)
            if parts:
                fresh[at] = len(own) / len(parts)
                echo[at] = len(own & before) / len(own)
                again[at] = line in seen
                seen.add(line)
            before = own
            at += 1
    columns = [
        np.log1p(size),
        np.log1p(words),
        ink / some / 10,
        n["upper"] / ink,
        n["digit"] / ink,
        n["stop"] / some,
        n["pause"] / some,
        n["shout"] / some,
        n["bar"] / some,
        n["mark"] / some,
        n["high"] / ink,
        (size == 0).astype(float),
        fresh,
        echo,
        again,
    ]
    if pairs is None:
        odds = np.zeros(len(size))
    else:
        code = np.zeros(len(data), np.float32)
        if len(data) > 1:
            code[1:] = pairs[data[:-1].astype(np.int32) * 256 + data[1:]]
        odds = _between(code, starts, ends, np.float64) / np.maximum(size, 1)
    own = np.stack([*columns, odds, np.clip(odds, -0.2, 0.2) * 5], axis=1)
    # Neighbours in the same document; beyond its ends there is nothing.
    first = np.zeros(len(size), bool)
    first[np.cumsum(counts) - counts] = True
    end = np.roll(first, -1)
    previous, following = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    previous[first], following[end] = 0, 0
    edge = np.stack([first, end], axis=1).astype(float)
    return Lines(np.concatenate([own, previous, following, edge], axis=1), size + 1, counts)


@dataclass
class Chain:
    """A trained model; `constant` stands for it where the labels hold a single class or none."""

    pairs: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0
    change: np.ndarray | None = None  # 2 x 2 weights of (state, next state)
    constant: float | None = None

    def margins(self, lines: Lines) -> np.ndarray:
        return np.clip((lines.features - self.mean) / self.scale, -6, 6) @ self.weights + self.bias

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """The share of each text that lies in good lines: marginals weighted by line length."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        lines = describe(texts, self.pairs)
        good, _ = marginals(self.margins(lines), self.change, lines.counts)
        owner = np.repeat(np.arange(len(texts)), lines.counts)
        total = np.bincount(owner, lines.weight, len(texts))
        return np.clip(np.bincount(owner, good * lines.weight, len(texts)) / total, 0, 1)


def marginals(margin: np.ndarray, change: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.

    Returns P(good) of every line, and the expected number of each (state, next state) over all
    chains.  Chains are sorted by length so that each step works on those that still go on.
    """
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    length = counts[order]
    steps = int(length[0]) if len(length) else 0
    # live[t]: chains with a line t.
    live = np.searchsorted(-length, -np.arange(steps), side="left")
    margin = np.clip(margin, -30, 30)
    emit = np.stack([1 / (1 + np.exp(margin)), 1 / (1 + np.exp(-margin))], axis=1)
    move = np.exp(change - change.max())
    forward = np.empty((len(margin), 2))
    state = np.full((len(counts), 2), 0.5)
    for t in range(steps):
        m = live[t]
        rows = begin[:m] + t
        state = (state[:m] @ move if t else state[:m]) * emit[rows]
        state /= state.sum(axis=1, keepdims=True)
        forward[rows] = state
    good = np.empty(len(margin))
    expected = np.zeros((2, 2))
    back = np.ones((len(counts), 2))
    for t in range(steps - 1, -1, -1):
        m = live[t]
        rows = begin[:m] + t
        joint = forward[rows] * back[:m]
        good[rows] = joint[:, 1] / joint.sum(axis=1)
        if t:
            carried = emit[rows] * back[:m]
            both = forward[rows - 1][:, :, None] * move[None] * carried[:, None, :]
            expected += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back[:m] = carried @ move.T
            back[:m] /= back[:m].sum(axis=1, keepdims=True)
    return good, expected


def train(lines: Lines, labels: np.ndarray, pairs: np.ndarray | None, rounds: int = 200, penalty: float = 2.0) -> Chain:
    """Maximises the penalised conditional likelihood of the line labels by Adam steps."""
    x = lines.features
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.clip((x - mean) / scale, -6, 6)
    y = np.repeat(labels.astype(float), lines.counts)
    inner = np.bincount(labels, lines.counts - 1, 2)
    observed = np.diag(inner)
    # Long documents should not outweigh the others: a line counts 1 / sqrt(lines of its document).
    value = np.concatenate([np.zeros(x.shape[1] + 1), np.zeros(4)])
    first, second = np.zeros_like(value), np.zeros_like(value)
    documents = max(1, len(labels))
    for step in range(1, rounds + 1):
        weights, bias, change = value[: x.shape[1]], value[x.shape[1]], value[-4:].reshape(2, 2)
        good, expected = marginals(x @ weights + bias, change, lines.counts)
        miss = y - good
        gradient = np.concatenate([x.T @ miss - penalty * weights, [miss.sum()], (observed - expected).ravel() - penalty * change.ravel()])
        gradient /= documents
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        rate = 0.08 * (1 - step / (rounds + 1))
        value = value + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Chain(pairs, mean, scale, value[: x.shape[1]], float(value[x.shape[1]]), value[-4:].reshape(2, 2))


def in_training(doc_id: Column) -> Column:
    """Rows that labels may be learned from: crc32 of the id as text is not a multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, lines: int = SAMPLE_LINES) -> Chain:
    """Trains on a bounded sample of labelled documents: the `rows` first by a hash of their id.

    Only labels of documents that are there count, and documents are taken whole, however long: those
    of a label are taken in the order of the hash until they hold half of `lines`.  The texts of the
    sample stay on the executors; the driver gathers byte-pair counts (at most 131,072 rows) and the
    features of at most `lines` lines and one document more per label, as packed arrays.  Labels that
    are null, and documents with several labels, are left out; of several texts of one doc_id the one
    of the smallest hash is taken.  Raises if the documents have both labels and the sample has one.
    Where they have one label, or none, the model is constant.
    """
    spark = docs.sparkSession
    ship(spark)
    stage = StageTables(spark, "quality")
    single = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id")
    single = single.agg(F.min("quality").alias("label"), F.max("quality").alias("_gl_max")).where("label = _gl_max")
    single = single.where(in_training(F.col("doc_id"))).select("doc_id", F.col("label").cast("int").alias("label"))
    present = docs.select("doc_id").join(single, "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"))
    present, _ = stage.put(present, "labelled")
    chosen, _ = stage.put(present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "chosen")
    # The chosen labels are at most `rows`, so they go to every task.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    texts, _ = stage.put(texts.select("doc_id", "label", F.col("one.text").alias("text")), "texts")
    held = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    before = Window.partitionBy("label").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    # At most `rows` narrow rows.
    taken = texts.select("doc_id", "label", F.xxhash64("doc_id").alias("h"), held.alias("lines"))
    taken = taken.withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0))).where(F.col("before") < lines / 2)
    sample = texts.join(F.broadcast(taken.select("doc_id")), "doc_id")
    sample = sample.select("doc_id", "label", F.col("text").cast("binary").alias("text"))
    # Byte pairs are learned on one half of the sample and the chain on the other, so that the
    # chain sees pair odds as they are on unseen text.
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    sample, _ = stage.put(sample.withColumn("half", half), "sample")
    sizes = {(r["half"], r["label"]): r["count"] for r in sample.groupBy("half", "label").count().collect()}
    kinds = {label for _, label in sizes}
    missing = {r["label"] for r in present.select("label").distinct().collect()} - kinds
    if missing:
        raise ValueError(f"no document of label {min(missing)} among the {rows} chosen: choose more rows")
    if len(kinds) < 2:
        return Chain(constant=float(kinds.pop()) if kinds else 1.0)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 65536), np.int64)
        for batch in slices(batches, "text"):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                data = np.frombuffer(text, np.uint8).astype(np.int32)
                if len(data) > 1:
                    totals[label] += np.bincount(data[:-1] * 256 + data[1:], minlength=65536) > 0
        label, code = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(totals[label, code])],
            names=["label", "code", "n"],
        )

    pairs = None
    if len(sizes) == 4:  # both halves have both labels
        table = np.zeros((2, 65536))
        counted = sample.where("half").mapInArrow(count_pairs, "label int, code int, n long")
        for row in counted.groupBy("label", "code").agg(F.sum("n").alias("n")).collect():
            table[row["label"], row["code"]] = row["n"]
        rate = (table + 0.5) / (np.array([[sizes[True, 0]], [sizes[True, 1]]]) + 1.0)
        pairs = np.clip(np.log(rate[1] / rate[0]), -2, 2).astype(np.float32)
        pairs[table.sum(axis=0) < 5] = 0

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = describe(batch.column("text").to_pylist(), pairs)
            ends = np.cumsum(found.counts)
            packed = [found.features[b - c : b].astype(np.float32).tobytes() for b, c in zip(ends, found.counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(found.counts.astype(np.int32)), pa.array(packed, pa.binary())],
                names=["doc_id", "label", "lines", "features"],
            )

    other = sample.where("NOT half") if pairs is not None else sample
    found = other.mapInArrow(features, "doc_id long, label int, lines int, features binary").orderBy("doc_id").collect()
    width = len(found[0]["features"]) // 4 // found[0]["lines"]
    matrix = np.frombuffer(b"".join(r["features"] for r in found), np.float32).reshape(-1, width).astype(np.float64)
    counts = np.array([r["lines"] for r in found])
    return train(Lines(matrix, np.ones(len(matrix)), counts), np.array([r["label"] for r in found]), pairs)


def score(docs: DataFrame, model: Chain, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of every whole text (0 to 1); a column of that name is replaced.

    A null text counts as empty: one line without bytes, scored like any other.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != name]
    source = docs.select(*kept, F.col(text).cast("binary").alias("_gl_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 65,536 pair weights and some dozen more
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_gl_text"):
            found = shared.value.score(batch.column("_gl_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found)], names=[*kept, name])

    return source.mapInArrow(run, schema)
