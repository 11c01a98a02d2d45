"""Operator 5: toxicity. A convolutional text classifier in numpy with thresholds by language.

Words are hashed whole and by their first three and five bytes, so that forms of one stem have something
in common. A hash seen in enough of the fitting texts has an embedding, the others are zero, and a word is
the sum of its three.
Filters of widths one, two and three run over the words, each filter's maximum over the whole text is
taken, and these are combined into a logit. The threshold of a logit depends on the language, which is
told from the text's own function words, and is calibrated on texts kept out of fitting; the score is
the logistic function of the distance from the threshold, so 0.5 is the threshold in each language.
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
from .quality import Adam, sigmoid

HASH_BITS = 20
WIDTH = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 12
BATCH = 32
#: Embeddings shrink so much after each round.
DECAY = 0.95
#: A word hash needs so many fitting texts to get an embedding of its own.
LEAST_TEXTS = 4
#: Embeddings' first values for one standard deviation.
START_SCALE = 0.2
#: Bytes of a word that are hashed: all of it, and its beginning.
PARTS = (64, 3, 5)
#: Labelled rows that a model is fitted on, at most.
FIT_ROWS = 12_000
STEP_BYTES = 1 << 19
# Common function words of each language.
FUNCTION_WORDS = {
    "en": "the and of to in is was that for with this are be as at on by",
    "de": "der die das und ein eine nicht ist von den zu im mit für auf",
    "fr": "le la les des et du un une est pour dans que qui sur par",
    "es": "el los que en una por con del las se como para su no lo",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_in_word = np.zeros(256, bool)
_in_word[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_power = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters, digits and bytes above 127; A-Z in lower case), a row for each
    of PARTS, and, for each text, the position of its first word and at last the number of words."""
    data = _lower[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    inside = np.concatenate([[False], _in_word[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    first = np.concatenate([[0], np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))]).astype(np.int64)
    if not len(start):
        return np.zeros((len(PARTS), 0), np.int64), first
    at = np.flatnonzero(inside[1:-1])
    size = end - start
    begin = np.cumsum(size) - size
    offset = np.arange(len(at)) - np.repeat(begin, size)
    value = (data[at].astype(np.uint64) + np.uint64(1)) * _power[offset % 64]
    out = np.empty((len(PARTS), len(start)), np.int64)
    for k, most in enumerate(PARTS):
        sums = np.add.reduceat(value if most >= 64 else np.where(offset < most, value, np.uint64(0)), begin)
        sums = (sums + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93)
        sums ^= sums >> np.uint64(32)
        out[k] = (sums * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - HASH_BITS)
    return out, first


@dataclass
class WordNetwork:
    number: np.ndarray  # by part, hash to row of the embedding: row 0 is zero, for padding and all others
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: width x WIDTH x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    language: np.ndarray  # word hash to 1 + language, 0 if it is no function word of one alone
    threshold: np.ndarray  # of the logit, by language

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.out, self.out_bias]

    def numbered(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the embedding, with padding after each text so that no filter reaches into the next."""
        pad = max(WIDTHS)
        rows = np.zeros((len(PARTS), hashes.shape[1] + pad * (len(first) - 1)), np.int32)
        texts = np.repeat(np.arange(len(first) - 1), np.diff(first))
        where = np.arange(hashes.shape[1]) + pad * texts
        for k in range(len(PARTS)):
            rows[k, where] = self.number[k][hashes[k]]
        return rows, first + pad * np.arange(len(first))

    def respond(self, rows: np.ndarray) -> np.ndarray:
        """Values of all filters at each position but the last ones, which are padding."""
        words = self.embedding[rows[0]]
        for k in range(1, len(PARTS)):
            words += self.embedding[rows[k]]
        n, parts = len(words) - max(WIDTHS) + 1, []
        for w, kernel in zip(WIDTHS, self.filters, strict=True):
            total = words[:n] @ kernel[0]
            for j in range(1, w):
                total += words[j : n + j] @ kernel[j]
            parts.append(total)
        return np.concatenate(parts, axis=1)

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Logits and languages of whole texts; long ones go through in overlapping steps."""
        pooled = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        hits = np.zeros((len(texts), len(LANGUAGES)), np.int64)
        queue: list[tuple[int, bytes]] = []

        def flush() -> None:
            if queue:
                who = [i for i, _ in queue]
                hashes, first = word_hashes([t for _, t in queue])
                rows, begin = self.numbered(hashes, first)
                np.maximum.at(pooled, who, _by_text(self.respond(rows), begin))
                spoken = self.language[hashes[0]]
                texts_of = np.repeat(who, np.diff(first))
                np.add.at(hits, (texts_of[spoken > 0], spoken[spoken > 0] - 1), 1)
                queue.clear()

        held = 0
        for i, text in enumerate(texts):
            for piece in steps(text):
                if held + len(piece) > STEP_BYTES:
                    flush()
                    held = 0
                queue.append((i, piece))
                held += len(piece)
        flush()
        logits = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias[0]
        most = hits.max(axis=1, initial=0)
        return logits.astype(np.float64), np.where(most > 0, hits.argmax(axis=1), LANGUAGES.index("other"))

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list[str]]:
        if not texts:
            return np.zeros(0), []
        logits, language = self.judge(texts)
        return sigmoid(logits - self.threshold[language]), [LANGUAGES[k] for k in language]


def _ends(begin: np.ndarray) -> np.ndarray:
    """Where each text's filters end: one that begins later would reach into the next text."""
    return begin[1:] - max(WIDTHS) + 1


def _by_text(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The maximum of each filter over the positions of each text alone."""
    edges = np.stack([begin[:-1], _ends(begin)], axis=1).ravel()[:-1]
    return np.maximum.reduceat(values, edges, axis=0)[::2]


def steps(text: bytes) -> Iterator[bytes]:
    """A long text in steps that end where a word ends and repeat the last few words before them.

    A run of bytes without any space is one step, whatever its length, as it is one word.
    """
    at = 0
    while len(text) - at > STEP_BYTES:
        end = text.rfind(b" ", at + STEP_BYTES // 2, at + STEP_BYTES)
        if end < 0:
            end = text.find(b" ", at + STEP_BYTES)
            if end < 0:
                break
        yield text[at:end]
        back = end
        for _ in range(2 * max(WIDTHS)):
            back = max(text.rfind(b" ", at + 1, back), at + 1)
        at = back
    yield text[at:]


def _language_table() -> np.ndarray:
    table = np.zeros(1 << HASH_BITS, np.int8)
    for k, words in enumerate(FUNCTION_WORDS.values()):
        hashes, _ = word_hashes([words.encode()])
        table[hashes[0]] = np.where(table[hashes[0]] == 0, k + 1, 0)
    return table


def fit(texts: list[bytes], labels: list[int], seed: int = 11) -> WordNetwork:
    """Fit on four fifths of the texts and calibrate the thresholds on the last fifth."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    kept, apart = order[len(texts) // 5 :], order[: len(texts) // 5]
    hashes = [word_hashes([t])[0].astype(np.int32) for t in texts]
    spread = _spread([hashes[i] for i in kept])
    known = spread >= LEAST_TEXTS
    number = np.zeros(spread.shape, np.int32)
    number[known] = 1 + np.arange(known.sum())

    def draw(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    embedding = draw(1 + known.sum(), WIDTH, scale=0.1)
    embedding[0] = 0
    net = WordNetwork(
        number, embedding, [draw(w, WIDTH, FILTERS, scale=(w * WIDTH) ** -0.5) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32), draw(FILTERS * len(WIDTHS), scale=0.3), np.zeros(1, np.float32),
        _language_table(), np.zeros(len(LANGUAGES)),
    )
    y = np.array(labels, np.float32)
    _start_from_counts(net, known, spread, _spread([hashes[i] for i in kept if labels[i] == 1]), len(kept))
    if len(set(labels)) < 2:
        net.out[:] = 0
        net.out_bias[0] = 0 if not labels else (4 if labels[0] else -4)
        return net
    adam = Adam(net.weights(), 0.01)
    for _ in range(EPOCHS):
        deal = rng.permutation(kept)
        for at in range(0, len(deal), BATCH):
            batch = deal[at : at + BATCH]
            adam.step(_gradients(net, [hashes[i] for i in batch], y[batch]))
            net.embedding[0] = 0
        net.embedding *= DECAY
    _calibrate(net, [texts[i] for i in apart], y[apart])
    return net


def _spread(hashes: list[np.ndarray]) -> np.ndarray:
    """In how many texts each hash stands, for each part."""
    out = np.zeros((len(PARTS), 1 << HASH_BITS), np.int32)
    for own in hashes:
        for k in range(len(PARTS)):
            out[k, np.unique(own[k])] += 1
    return out


def _start_from_counts(net: WordNetwork, known: np.ndarray, spread: np.ndarray, marked: np.ndarray, n: int) -> None:
    """Let training begin where few texts already tell something: one direction of the embeddings, read by
    the first filter, says by how many standard deviations a hash stands in more texts of label 1 than
    chance would have it."""
    share = marked.max(axis=1, initial=0).max() / max(1, n)
    base = np.clip(share, 0.01, 0.5)
    texts, own = spread[known], marked[known]
    z = (own - texts * base) / np.sqrt(texts * base * (1 - base) + 1)
    net.embedding[1:, 0] = START_SCALE * z
    net.filters[0][0, :, 0] = 0
    net.filters[0][0, 0, 0] = 1
    net.out[0] = 1


def _calibrate(net: WordNetwork, texts: list[bytes], y: np.ndarray) -> None:
    """The threshold of a language makes the fewest errors on its texts, all texts' weighing in a little;
    it is midway in the widest gap between logits that does."""
    logits, language = net.judge(texts)
    everything = np.sort(logits)
    cuts = np.concatenate([[0.0], (everything[1:] + everything[:-1]) / 2])
    wrong = np.array([((logits >= c) != (y == 1)).astype(float) for c in cuts])
    for k in range(len(LANGUAGES)):
        weight = 0.05 + (language == k)
        errors = wrong @ weight + 0.01 * np.abs(cuts)
        net.threshold[k] = cuts[errors.argmin()]


def _gradients(net: WordNetwork, hashes: list[np.ndarray], y: np.ndarray) -> list:
    first = np.cumsum([0, *(h.shape[1] for h in hashes)])
    rows, begin = net.numbered(np.concatenate(hashes, axis=1), first)
    values = net.respond(rows)
    at = np.stack([a + values[a:b].argmax(axis=0) for a, b in zip(begin[:-1], _ends(begin), strict=True)])
    pooled = np.take_along_axis(values, at, axis=0) + net.bias
    active = np.maximum(pooled, 0)
    error = (sigmoid(active @ net.out + net.out_bias[0]) - y).astype(np.float32) / len(y)
    grad = error[:, None] * net.out * (pooled > 0)
    touched, shares, g_filters = [], [], []
    for n, (w, kernel) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        own = slice(n * FILTERS, (n + 1) * FILTERS)
        g_kernel = np.zeros_like(kernel)
        for j in range(w):
            share = (grad[:, own, None] * kernel[j].T).reshape(-1, WIDTH)
            for k in range(len(PARTS)):
                words = rows[k][at[:, own] + j]
                g_kernel[j] += np.einsum("dfk,df->kf", net.embedding[words], grad[:, own])
                touched.append(words.ravel())
                shares.append(share)
        g_filters.append(g_kernel)
    own, where = np.unique(np.concatenate(touched), return_inverse=True)
    g_embedding = np.zeros((len(own), WIDTH), np.float32)
    np.add.at(g_embedding, where, np.concatenate(shares))
    return [(own, g_embedding), *g_filters, grad.sum(axis=0), active.T @ error, error.sum(keepdims=True)]


def score_documents(docs: DataFrame, net: WordNetwork) -> DataFrame:
    """Score the whole text of each row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, score double in 0 to 1 (0.5: the threshold of the text's language) and language (as
    told from the text), one row per row. The model is broadcast; its tables have a fixed number of
    entries but for the embeddings, of which there are fewer than words in FIT_ROWS texts. A null text
    counts as empty; a text without words is scored as padding.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            score, language = model.value.score(batch.column("data").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(language, pa.string())], ["doc_id", "score", "language"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(whole_text(), "UTF-8").alias("data"))
    return rows.mapInArrow(run, "doc_id bigint, score double, language string")


def toxicity_network(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> WordNetwork:
    """Fit on at most ``rows`` labelled rows that are not held out (crc32 of the doc_id mod 5 is not 0)."""
    return fit(*fitting_sample(docs, labels, "toxic", remainder(F.col("doc_id"), 5) != 0, rows))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs, toxicity_network(docs, labels)).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "language",
    )
