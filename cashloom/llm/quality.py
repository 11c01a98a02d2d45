"""Operator 4: quality classifier. A byte-level convolutional network in numpy.

Every byte has a learned embedding; a chunk of 16 bytes starts at every eighth byte, so chunks overlap and
cover the whole document. One more input of each block tells whether its bytes were there just before,
which no filter of this width could see. Learned filters over a chunk are rectified, each filter's maximum over all
chunks is taken, and these are combined into one probability. A chunk is two blocks of 8 bytes, so the
convolution is two matrix products over the same unstacked blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces, whole_text
from .labelled import fitting_sample, remainder

BLOCK = 8
WIDTH = 8
#: A block is an echo if its bytes also start at most so many bytes before.
ECHO = 40
INPUTS = BLOCK * WIDTH + 1
FILTERS = 32
EPOCHS = 12
#: Labelled rows that a model is fitted on, at most.
FIT_ROWS = 3_000
#: Bytes that are convolved at once, which bounds a worker's memory for texts of any length.
STEP_BYTES = 1 << 19


def blocks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each filled with zeros to whole blocks and at least two, and first blocks."""
    sizes = [max(2, -(-len(t) // BLOCK)) for t in texts]
    first = np.cumsum([0, *sizes])
    flat = np.frombuffer(b"".join(t.ljust(n * BLOCK, b"\0") for t, n in zip(texts, sizes, strict=True)), np.uint8)
    return flat.reshape(-1, BLOCK), first


def echoes(blocks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1.0 for each block that repeats the 8 bytes at some distance up to ECHO before it in its text."""
    data = b"\0" * ECHO + blocks.tobytes()
    place = (np.arange(len(blocks)) - np.repeat(first[:-1], np.diff(first))) * BLOCK
    own = np.frombuffer(data, "<u8", offset=ECHO)
    out = np.zeros(len(blocks), bool)
    for d in range(1, ECHO + 1):
        out |= (own == np.frombuffer(data, "<u8", len(blocks), ECHO - d)) & (place >= d)
    return out.astype(np.float32)


@dataclass
class ByteNetwork:
    embedding: np.ndarray  # 256 x WIDTH
    near: np.ndarray  # INPUTS x FILTERS, for a chunk's first block
    far: np.ndarray  # the same for its second block
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def start(rng: np.random.Generator) -> ByteNetwork:
        def draw(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        size = INPUTS
        return ByteNetwork(
            draw(256, WIDTH, scale=0.5), draw(size, FILTERS, scale=size**-0.5), draw(size, FILTERS, scale=size**-0.5),
            np.zeros(FILTERS, np.float32), draw(FILTERS, scale=FILTERS**-0.5), np.zeros(1, np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, self.near, self.far, self.bias, self.out, self.out_bias]

    def inputs(self, blocks: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = np.empty((len(blocks), INPUTS), np.float32)
        x[:, :-1] = self.embedding[blocks].reshape(len(blocks), -1)
        x[:, -1] = echoes(blocks, first)
        return x

    def respond(self, x: np.ndarray) -> np.ndarray:
        """Filter values of the chunks that start at all blocks but the last."""
        return x[:-1] @ self.near + x[1:] @ self.far

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """Maxima of the filters over each whole text, before bias and rectifier."""
        best = np.full((len(texts), FILTERS), -np.inf, np.float32)
        small: list[int] = []

        def flush() -> None:
            if small:
                blocks, first = blocks_of([texts[i] for i in small])
                values = self.respond(self.inputs(blocks, first))
                values[first[1:-1] - 1] = -np.inf  # chunks that would reach into the next text
                best[small] = np.maximum.reduceat(values, first[:-1], axis=0)
                small.clear()

        held = 0
        for i, text in enumerate(texts):
            if len(text) > STEP_BYTES:
                for at in range(0, len(text), STEP_BYTES):  # steps overlap, so that no chunk or echo is lost
                    values = self.respond(self.inputs(*blocks_of([text[max(0, at - ECHO) : at + STEP_BYTES + BLOCK]])))
                    best[i] = np.maximum(best[i], values.max(axis=0))
                continue
            if held + len(text) > STEP_BYTES:
                flush()
                held = 0
            small.append(i)
            held += len(text) + 2 * BLOCK
        flush()
        return best

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias[0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return sigmoid(self.logits(self.pool(texts)).astype(np.float64))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Adam:
    def __init__(self, weights: list[np.ndarray], rate: float):
        self.weights, self.rate, self.t = weights, rate, 0
        self.mean = [np.zeros_like(w) for w in weights]
        self.square = [np.zeros_like(w) for w in weights]

    def step(self, gradients: list) -> None:
        """A gradient is an array, or rows of one (all others zero; their moments stay as they are)."""
        self.t += 1
        for w, g, m, s in zip(self.weights, gradients, self.mean, self.square, strict=True):
            own, g = g if isinstance(g, tuple) else (slice(None), g)
            m[own] += 0.1 * (g - m[own])
            s[own] += 0.001 * (g * g - s[own])
            w[own] -= self.rate * (m[own] / (1 - 0.9**self.t)) / (np.sqrt(s[own] / (1 - 0.999**self.t)) + 1e-8)


def fit(texts: list[bytes], labels: list[int], seed: int = 7) -> ByteNetwork:
    """Fit a network by Adam on mini-batches; a text's gradient flows through its maximal chunks."""
    rng = np.random.default_rng(seed)
    net = ByteNetwork.start(rng)
    if len(set(labels)) < 2:  # nothing to tell apart: the share of label 1, if there is any
        net.out[:] = 0
        net.out_bias[0] = 0 if not labels else (4 if labels[0] else -4)
        return net
    y_all = np.array(labels, np.float32)
    adam = Adam(net.weights(), 0.004)
    for _ in range(EPOCHS):
        order, batch, held = rng.permutation(len(texts)), [], 0
        for n, i in enumerate(order):
            batch.append(i)
            held += len(texts[i])
            if len(batch) == 16 or held > STEP_BYTES or n + 1 == len(order):
                adam.step(_gradients(net, [texts[j] for j in batch], y_all[batch]))
                batch, held = [], 0
    return net


def _gradients(net: ByteNetwork, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    blocks, first = blocks_of(texts)
    x = net.inputs(blocks, first)
    values = net.respond(x)
    at = np.stack([a + values[a : b - 1].argmax(axis=0) for a, b in zip(first, first[1:], strict=False)])
    pooled = np.take_along_axis(values, at, axis=0) + net.bias
    active = np.maximum(pooled, 0)
    error = (sigmoid(active @ net.out + net.out_bias[0]) - y).astype(np.float32) / len(y)
    grad = error[:, None] * net.out * (pooled > 0)
    near_bytes, far_bytes = blocks[at], blocks[at + 1]  # texts x filters x BLOCK
    g_near = np.einsum("dfk,df->kf", x[at], grad)
    g_far = np.einsum("dfk,df->kf", x[at + 1], grad)
    g_embedding = np.zeros_like(net.embedding)
    for where, w in ((near_bytes, net.near), (far_bytes, net.far)):
        share = grad[..., None, None] * w[:-1].T.reshape(1, FILTERS, BLOCK, WIDTH)
        np.add.at(g_embedding, where.ravel(), share.reshape(-1, WIDTH))
    return [g_embedding, g_near, g_far, grad.sum(axis=0), active.T @ error, error.sum(keepdims=True)]


def score_documents(docs: DataFrame, net: ByteNetwork) -> DataFrame:
    """Score the whole text of each row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, score double in 0 to 1 (higher: quality 1 likelier), one row per row; the model, of a
    fixed size, is broadcast. A null text counts as empty, and an empty one is scored as a chunk of zeros.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            score = model.value.score(batch.column("data").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(whole_text(), "UTF-8").alias("data"))
    return rows.mapInArrow(run, "doc_id bigint, score double")


def keep_quality(docs: DataFrame, net: ByteNetwork, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns as they are, whose score is at least ``least``."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [(t or "").encode("utf-8") for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(model.value.score(texts) >= least))

    return docs.mapInArrow(run, docs.schema)


def quality_network(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> ByteNetwork:
    """Fit on at most ``rows`` labelled rows that are not held out (crc32 of the doc_id mod 3 is not 1)."""
    return fit(*fitting_sample(docs, labels, "quality", remainder(F.col("doc_id"), 3) != 1, rows))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs, quality_network(docs, labels)).select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
