"""Quality classifier: a linear-chain conditional random field labels every line good or bad."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ship, spans, table, utf8, word_hashes, words

#: The field is fitted on so many labelled documents at most, the first by a hash of their id, leaving out those of more
#: code points than LONGEST: 80 MB of text at the very most, in one task.
MOST_LABELLED, LONGEST, EPOCHS, PENALTY = 4000, 20_000, 300, 1e-3
CUT = 0.7

_CLASSES = np.zeros((256, 6), np.float32)  # upper, lower or other letter, digit, sentence mark, bar, other sign
_CLASSES[65:91, 0] = 1
_CLASSES[97:123, 1] = 1
_CLASSES[128:, 1] = 1
_CLASSES[48:58, 2] = 1
for _c in b".,;:?'\"()-":
    _CLASSES[_c, 3] = 1
_CLASSES[ord("|"), 4] = 1
for _c in b"!#$%&*+/<=>@[\\]^_`{}~":
    _CLASSES[_c, 5] = 1
N_LINE = 15


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line (3 * N_LINE + 1: its own, the one's before, the one's after, a constant), its length in
    bytes plus one, and the offsets of each row's lines. A text has one line more than line feeds."""
    feeds = np.flatnonzero(data == 10)
    n_lines = np.searchsorted(feeds, at[1:]) - np.searchsorted(feeds, at[:-1]) + 1
    own = np.concatenate([[0], np.cumsum(n_lines)])
    start = np.empty(own[-1], np.int64)
    is_first = np.zeros(own[-1], bool)
    is_first[own[:-1]] = True
    start[is_first], start[~is_first] = at[:-1], feeds + 1
    end = np.empty_like(start)
    end[:-1], end[-1:] = start[1:], at[-1:]
    closed = np.ones(len(start), bool)  # ends with a line feed
    closed[own[1:] - 1] = False
    end[own[1:] - 1] = at[1:]
    end = end - closed
    size = np.maximum(end - start, 0)
    sums = np.concatenate([np.zeros((1, 6), np.float64), np.cumsum(_CLASSES[data], 0, dtype=np.float64)]) if len(data) else np.zeros((1, 6))
    share = (sums[end] - sums[start]) / np.maximum(size, 1)[:, None]
    ws, we, _ = words(data, at)
    h = word_hashes(data, ws, we)
    lo, hi = np.searchsorted(ws, start), np.searchsorted(ws, end)
    n_words = hi - lo
    count = lambda flags: np.concatenate([[0], np.cumsum(flags)])[hi] - np.concatenate([[0], np.cumsum(flags)])[lo]
    again = np.zeros(len(h), bool)
    for lag in (1, 2, 3):
        again[lag:] |= h[lag:] == h[:-lag]
    length = we - ws
    per = 1 / np.maximum(n_words, 1)
    tail = data[we - 1] if len(we) else np.zeros(0, np.uint8)
    signed = _CLASSES[tail, 4] + _CLASSES[tail, 5] > 0
    x = np.column_stack([
        share, np.log1p(size) / 8, np.log1p(n_words) / 6, count(again) * per, count(length <= 3) * per, count(length > 12) * per,
        count(signed) * per, is_first, ~closed, np.minimum(np.repeat(n_lines, n_lines), 20) / 20,
    ]).astype(np.float64)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[is_first] = 0
    after[~closed] = 0
    return np.column_stack([x, before, after, np.ones(len(x))]), size + 1.0, own


def _padded(own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of chains of like length: indices of their lines (chains x steps) and which of them are there."""
    size = np.diff(own)
    level = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    for v in np.unique(level):
        rows = np.flatnonzero(level == v)
        steps = np.arange(size[rows].max())
        there = steps[None, :] < size[rows][:, None]
        yield np.where(there, own[rows][:, None] + steps[None, :], 0), there


def marginals(emit: np.ndarray, move: np.ndarray, own: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward in log space over chains: log marginals of the two labels of each line, the expected moves
    between labels (each chain's times its weight), and each chain's log partition. emit: lines x 2, move: 2 x 2."""
    out, moves = np.zeros_like(emit), np.zeros((2, 2))
    total = np.zeros(len(own) - 1)
    size = np.diff(own)
    level = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    for at, there in _padded(own):
        n, steps = at.shape
        chains = np.flatnonzero(level == int(np.ceil(np.log2(max(steps, 1)))))
        share = np.ones(n) if weight is None else weight[chains]
        e = np.where(there[..., None], emit[at], 0)
        f = np.empty((steps, n, 2))
        f[0] = e[:, 0]
        for t in range(1, steps):
            nxt = np.logaddexp(f[t - 1][:, :1] + move[0], f[t - 1][:, 1:] + move[1]) + e[:, t]
            f[t] = np.where(there[:, t, None], nxt, f[t - 1])
        b = np.zeros((n, 2))
        z = np.logaddexp(f[-1][:, 0], f[-1][:, 1])
        for t in range(steps - 1, -1, -1):
            ok = there[:, t]
            out[at[ok, t]] = f[t][ok] + b[ok] - z[ok, None]
            if t:
                inner = e[:, t] + b
                pair = np.exp(f[t - 1][:, :, None] + move[None] + inner[:, None, :] - z[:, None, None])
                moves += (pair[ok] * share[ok, None, None]).sum(0)
                nb = np.logaddexp(move[:, 0] + inner[:, :1], move[:, 1] + inner[:, 1:])
                b = np.where(ok[:, None], nb, b)
        total[chains] = z
    return out, moves, total


def loss(x: np.ndarray, own: np.ndarray, y: np.ndarray, w: np.ndarray, move: np.ndarray, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Minus the mean log likelihood of the line labels y, each document's divided by its number of lines so that it
    counts as one, plus the penalty; and the exact gradient in w and move."""
    per, n = 1 / np.diff(own), len(own) - 1
    line = np.repeat(per, np.diff(own))
    emit = x @ w
    logp, moves, total = marginals(np.column_stack([np.zeros(len(x)), emit]), move, own, per)
    inner = np.ones(len(x), bool)
    inner[own[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), line[at])
    value = (per @ total - line @ (emit * y) - (seen * move).sum()) / n + penalty / 2 * (w @ w + 10 * (move**2).sum())
    return value, x.T @ ((np.exp(logp[:, 1]) - y) * line) / n + penalty * w, (moves - seen) / n + 10 * penalty * move


def fit(x: np.ndarray, own: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, penalty: float = PENALTY) -> dict[str, np.ndarray]:
    """Maximum likelihood of the line labels (each line carries its document's) by Adam on the gradient of loss."""
    mean, dev = x[:, :-1].mean(0), x[:, :-1].std(0) + 1e-6
    x = np.column_stack([(x[:, :-1] - mean) / dev, np.ones(len(x))])
    y = np.repeat(label, np.diff(own))
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(move), np.zeros_like(move)]
    for step in range(1, epochs + 1):
        _, gw, gm = loss(x, own, y, w, move, penalty)
        for k, (g, p) in enumerate(((gw, w), (gm, move))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {"mean": mean, "dev": dev, "w": w, "move": move}


def line_probabilities(model: dict[str, np.ndarray], x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The chance that each line is good, given all lines of its text."""
    z = np.column_stack([(x[:, :-1] - model["mean"]) / model["dev"], np.ones(len(x))])
    return np.exp(marginals(np.column_stack([np.zeros(len(z)), z @ model["w"]]), model["move"], own)[0][:, 1])


def remainder(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 4


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, longest: int = LONGEST) -> dict[str, np.ndarray] | None:
    """The field, fitted on at most `most` labelled documents that aren't held out: those whose hashed id is smallest,
    but for texts of more than `longest` code points. An id's label is its highest, its text the first in order, so that
    repeated rows count once. The fit runs in one task over that bounded sample; the driver gets the weights.
    None if there are no labels."""
    ship(docs.sparkSession)
    known = labels.where(remainder() != 2).where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.char_length("text") <= longest).join(F.broadcast(known), "doc_id")
    some = some.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").cast("int").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        if got.num_rows:
            got = got.sort_by("doc_id").combine_chunks()
            data, at = utf8(got["text"].combine_chunks())
            parts = [line_features(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]) for lo, hi in spans(at)]
            own = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
            model = fit(np.concatenate([p[0] for p in parts]), own, got["quality"].to_numpy().astype(int))
            yield pa.RecordBatch.from_arrays([pa.array(list(model)), pa.array([v.ravel() for v in model.values()])], ["name", "value"])

    model = {r.name: np.array(r.value) for r in some.coalesce(1).mapInArrow(run, "name string, value array<double>").collect()}
    return model | {"move": model["move"].reshape(2, 2)} if model else None


def scored(docs: DataFrame, model: dict[str, np.ndarray] | None, keep: list[str]) -> DataFrame:
    """row, a struct of the columns keep of docs, and score (0 to 1), from its text (null: empty): the marginal chance
    that a line is good, averaged over lines by length. Without a model every score is 1.

    An empty text is one empty line. Repeated rows get equal scores, whatever their ids, which are never read. A very
    long text is one chain, and is held by its task alone. Other columns are ignored; an empty table gives an empty
    result. Texts are not moved."""
    ship(docs.sparkSession)
    fields = docs.select(F.struct(*keep).alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for lo, hi in spans(at):
                if model is None:
                    score = np.ones(hi - lo)
                else:
                    x, weight, own = line_features(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                    good = line_probabilities(model, x, own)
                    score = np.add.reduceat(good * weight, own[:-1]) / np.add.reduceat(weight, own[:-1])
                yield pa.RecordBatch.from_arrays([batch.column("row")[lo:hi], pa.array(np.clip(score, 0, 1))], ["row", "score"])

    return fields.mapInArrow(run, f"row {fields.schema['row'].dataType.simpleString()}, score double")


def quality_scores(docs: DataFrame, model: dict[str, np.ndarray] | None, keep: list[str]) -> DataFrame:
    """The columns keep of docs, none of them named score, and score."""
    return scored(docs, model, keep).select("row.*", "score")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row gets a score; repeated rows get equal ones, a null doc_id is not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = quality_scores(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    held = F.coalesce(remainder() == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
