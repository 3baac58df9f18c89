"""Document quality by a small convolutional network over bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.llm import windows as W
from shelfwright.llm.scratch import Scratch

WIDTH = 4
#: Window starts of one chunk; a chunk's bytes overlap the next one's by WIDTH - 1.
CHUNK = 252
FILTERS = 8
#: Bounds of what is fitted on: labelled rows, and bytes of their texts together. Of a row in the sample the whole text counts.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 24 << 20


@dataclass
class Network:
    """Filters as one weight per place and byte; a document's chunk maxima are combined by their maximum and mean."""

    filters: np.ndarray  # WIDTH x FILTERS x 256
    bias: np.ndarray
    top: np.ndarray
    mean: np.ndarray
    offset: float

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The first two and the last two places as one table each over pairs of bytes."""
        f = self.filters.astype(np.float32)
        first = f[0][:, :, None] + f[1][:, None, :] + self.bias.astype(np.float32)[:, None, None]
        second = f[2][:, :, None] + f[3][:, None, :]
        return first.reshape(FILTERS, -1), second.reshape(FILTERS, -1)

    def score(self, top: np.ndarray, mean: np.ndarray) -> np.ndarray:
        logit = top @ self.top + mean @ self.mean + self.offset
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def pooled(data: np.ndarray, offsets: np.ndarray, network: Network) -> tuple[np.ndarray, np.ndarray]:
    """Maximum and mean over the chunk maxima of each row, every byte of every row included."""
    first, second = network.tables()
    rows = len(offsets) - 1
    lengths = np.diff(offsets)
    top, total = np.zeros((rows, FILTERS)), np.zeros((rows, FILTERS))
    chunks = -(-lengths // CHUNK)
    row_of = np.repeat(np.arange(rows), chunks)
    starts = offsets[:-1][row_of] + CHUNK * (np.arange(len(row_of)) - np.repeat(np.cumsum(chunks) - chunks, chunks))
    stops = np.minimum(starts + CHUNK, offsets[1:][row_of])
    for k in range(0, len(starts), 1024):
        s, e = starts[k : k + 1024], stops[k : k + 1024]
        size = e - s + WIDTH - 1
        begin = np.cumsum(size) - size
        spot = np.repeat(s - begin, size) + np.arange(size.sum())
        limit = np.repeat(offsets[1:][row_of[k : k + 1024]], size)
        block = np.where(spot < limit, data[np.minimum(spot, len(data) - 1)], 0).astype(np.int64)
        pair = block[:-1] * 256 + block[1:]
        ends = begin + e - s
        edges = np.stack([begin, ends], axis=1).ravel()
        mine = row_of[k : k + 1024]
        for f in range(FILTERS):
            value = first[f].take(pair[:-2]) + second[f].take(pair[2:])
            best = np.maximum(np.maximum.reduceat(value, edges[:-1])[::2], 0)
            np.maximum.at(top[:, f], mine, best)
            np.add.at(total[:, f], mine, best)
    return top, total / np.maximum(chunks, 1)[:, None]


def fit(chunks: list[list[bytes]], labels: np.ndarray, steps: int = 1000, seed: int = 11) -> Network:
    """Gradient descent (Adam) on the log loss; gradients go to the windows that gave the maxima.

    A small sample is gone through more often, so that it takes as many steps as a large one.
    """
    rng = np.random.default_rng(seed)
    params = [
        rng.normal(0, 0.3, (WIDTH, FILTERS, 256)), np.full(FILTERS, 0.1), rng.normal(0, 0.3, FILTERS),
        rng.normal(0, 0.3, FILTERS), np.zeros(1),
    ]
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
    params[4][0] = np.log(share / (1 - share))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    used = [k for k, c in enumerate(chunks) if c]
    if not used:  # nothing learned, nothing told
        params[2][:] = params[3][:] = 0
    padded = {}
    for k in used:
        block = np.zeros((len(chunks[k]), CHUNK + WIDTH - 1), dtype=np.uint8)
        valid = np.zeros((len(chunks[k]), CHUNK), dtype=bool)
        for i, c in enumerate(chunks[k]):
            block[i, : len(c)] = np.frombuffer(c, dtype=np.uint8)
            valid[i, : max(1, len(c) - WIDTH + 1)] = True
        padded[k] = block, valid
    step, names = 0, np.arange(FILTERS)
    while used and step < steps:
        order = rng.permutation(used)
        for at in range(0, len(order), 32):
            some = order[at : at + 32]
            step += 1
            block = np.concatenate([padded[k][0] for k in some])
            valid = np.concatenate([padded[k][1] for k in some])
            sizes = np.array([len(padded[k][0]) for k in some])
            begin = np.cumsum(sizes) - sizes
            w, bias, top_w, mean_w, offset = params
            value = np.full((FILTERS, len(block), CHUNK), bias[:, None, None], dtype=np.float32)
            for p in range(WIDTH):
                value += w[p].astype(np.float32)[:, block[:, p : p + CHUNK]]
            value[:, ~valid] = -1e9
            place = value.argmax(axis=2)
            raw = np.take_along_axis(value, place[:, :, None], 2)[:, :, 0]
            best = np.maximum(raw, 0)
            top = np.maximum.reduceat(best, begin, axis=1)
            mean = np.add.reduceat(best, begin, axis=1) / sizes
            logit = top_w @ top + mean_w @ mean + offset[0]
            error = (1 / (1 + np.exp(-logit)) - labels[some]) / len(some)
            row = np.repeat(np.arange(len(some)), sizes)
            winner = np.zeros_like(best)
            is_top = best == top[:, row]
            winner[is_top] = 1
            winner /= np.maximum(np.add.reduceat(winner, begin, axis=1)[:, row], 1)
            back = error[row] * (top_w[:, None] * winner + mean_w[:, None] / sizes[row]) * (raw > 0)
            grads = [np.zeros_like(w), back.sum(axis=1), top @ error, mean @ error, np.array([error.sum()])]
            f, c = np.nonzero(back)
            for p in range(WIDTH):
                np.add.at(grads[0][p], (names[f], block[c, place[f, c] + p]), back[f, c])
            for value_, grad, (m, v) in zip(params, grads, moments, strict=True):
                grad = grad + 1e-4 * value_
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                value_ -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(params[0], params[1], params[2], params[3], float(params[4][0]))


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from learning: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def chunks_of(text: bytes) -> list[bytes]:
    """All chunks of a text, each with the bytes it shares with the next one."""
    return [text[k : k + CHUNK + WIDTH - 1] for k in range(0, len(text), CHUNK)]


def learn(
    docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Network:
    """A network fitted on whole texts of at most ``rows`` labelled documents that are not held out.

    The rows are those with the smallest hash of their id, and of these, by the hash of their text, as many as together have
    at most ``most_bytes``; they are what the driver holds. Null ids and labels are left out; an id labelled twice
    counts once, with its smaller label. Without any labelled row the network gives every text the score 0.5.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("int").alias("quality"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    sample = (
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "id")  # at most `rows` rows of two numbers
        .select("quality", "text", F.xxhash64("text").alias("place"))
        .orderBy("place", "quality", "text").limit(rows)
    )
    before = Window.orderBy("place", "quality", "text").rowsBetween(Window.unboundedPreceding, 0)
    sized = sample.withColumn("bytes", F.sum(F.octet_length("text")).over(before)).where(F.col("bytes") <= most_bytes)
    found = sized.select("quality", "text").collect()  # bounded by both parameters
    return fit([chunks_of(r["text"].encode()) for r in found], np.array([r["quality"] for r in found], dtype=np.float64))


def scorer(network: Network):
    """A Column function: the probability that a text is good. Null and empty texts get that of no evidence."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        data, offsets = W.raw(text)
        if len(data) == 0:
            data = np.zeros(1, dtype=np.uint8)
        return pa.array(network.score(*pooled(data, offsets, network)))

    return score


def score_documents(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The input's rows as ``row``, with ``held_out``, ``score`` and ``predicted`` (1 from the threshold on).

    The whole text is scored, in overlapping chunks; nothing but the text is an input. Rows with a null id are not
    held out. Repeated rows stay. Columns pass through inside ``row``, where their names cannot clash. An empty table
    gives an empty table.
    """
    Scratch(docs.sparkSession, "quality")
    network = learn(docs, labels, id_col=id_col, text_col=text_col)
    text = F.col(f"row.{text_col}").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return (
        rows.withColumn("score", scorer(network)(text))
        .withColumn("held_out", held_out(F.col(f"row.{id_col}")))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
