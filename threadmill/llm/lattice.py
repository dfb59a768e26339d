"""LM scoring: a subword lattice sums over all segmentations of each word into pieces of an existing vocabulary."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ship, stored, table, utf8

#: A token with at least this share of all training tokens goes to every task: there are at most 1 / HEAD_SHARE.
HEAD_SHARE = 1 / 150_000
ROUNDS = 3  # of expectation maximisation over the pieces
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD_START = "▁"


class Vocabulary(NamedTuple):
    """Pieces of a sentencepiece model as a trie over code points, and start weights."""

    pieces: dict[str, int]
    as_byte: np.ndarray  # ids of the 256 byte pieces
    start: np.ndarray  # log probability by id; the last entry is the end of a text
    symbol: np.ndarray  # number of each code point; 0: in no piece
    tables: list[tuple[np.uint64, np.ndarray, np.ndarray]]  # (state, symbol) -> state, in hash tables: factor, keys, states
    piece: np.ndarray  # the piece that ends in a state, or -1


SLOT_BITS = 19


@cache
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a sentencepiece file; read once in each worker.

    The file's scores are minus the rank of each piece, not logarithms; a piece's probability at the start falls with
    its rank by Zipf's law. Byte pieces have no rank and come last."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    as_byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    score = np.array([sp.get_score(i) for i in range(n)])
    start = np.full(n + 1, -math.log(n + 10.0))
    usual = list(pieces.values())
    start[usual] = -np.log(-score[usual] + 10.0)
    return make_vocabulary(pieces, as_byte, start - np.logaddexp.reduce(start))


def make_vocabulary(pieces: dict[str, int], as_byte: np.ndarray, start: np.ndarray) -> Vocabulary:
    number = {c: k + 1 for k, c in enumerate(sorted({c for p in pieces for c in p}))}
    symbol = np.zeros(0x110000, np.int64)
    symbol[[ord(c) for c in number]] = list(number.values())
    states, ends, key, to = {"": 0}, {}, [], []
    for p, i in pieces.items():
        at = 0
        for k, c in enumerate(p):
            new = states.setdefault(p[: k + 1], len(states))
            if new == len(states) - 1 and p[: k + 1] not in ends:
                ends[p[: k + 1]] = -1
                key.append(at << 24 | number[c])
                to.append(new)
            at = new
        ends[p] = i
    piece = np.full(len(states), -1, np.int64)
    for p, i in ends.items():
        piece[states[p]] = i
    key, to, tables = np.array(key, np.uint64), np.array(to, np.int64), []
    for factor in map(np.uint64, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
        slot = (key * factor >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        here = np.unique(slot, return_index=True)[1]  # keys whose slot is taken go to the next table
        keys, values = np.full(1 << SLOT_BITS, 2**64 - 1, np.uint64), np.zeros(1 << SLOT_BITS, np.int64)
        keys[slot[here]], values[slot[here]] = key[here], to[here]
        tables.append((factor, keys, values))
        rest = np.ones(len(key), bool)
        rest[here] = False
        key, to = key[rest], to[rest]
        if not len(key):
            break
    assert not len(key), "states without a slot"
    return Vocabulary(pieces, as_byte, start, symbol, tables, piece)


class Lattice:
    """All segmentations of words into pieces, many words of one length at a time. A word starts with the mark of its
    vocabulary, so that pieces tell where words begin and no end of a word is needed."""

    def __init__(self, vocabulary: Vocabulary, logp: np.ndarray | None = None):
        self.v, self.none = vocabulary, len(vocabulary.start)
        self.logp = vocabulary.start if logp is None else logp

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after symbol, 0 for none."""
        key = (state << 24 | symbol).astype(np.uint64)
        out = np.zeros(len(key), np.int64)
        left = np.flatnonzero(symbol)
        for factor, keys, values in self.v.tables:
            k = key[left]
            slot = (k * factor >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            hit = keys[slot] == k
            out[left[hit]] = values[slot[hit]]
            left = left[~hit]
        return out

    def _arcs(self, words: list[str]) -> tuple[np.ndarray, dict[int, list[int]]]:
        """ids[w, j, k]: the piece that ends before j and has k + 1 characters, or none; and what the ids past the
        vocabulary stand for: characters without a piece, spelled in bytes."""
        count, n = len(words), len(words[0]) + 1
        codes = np.frombuffer("".join(WORD_START + w for w in words).encode("utf-32-le"), np.uint32).reshape(count, n)
        symbol = self.v.symbol[codes].ravel()
        place = np.arange(count * n)
        left = n - place % n  # characters from here to the word's end
        state, found = np.zeros(count * n, np.int64), []
        for k in range(n):
            state = self._step(state, symbol[place + k])
            alive = state > 0
            place, state, left = place[alive], state[alive], left[alive]
            piece = self.v.piece[state]
            here = piece >= 0
            found.append((place[here], piece[here]))
            more = left > k + 1
            place, state, left = place[more], state[more], left[more]
            if not len(place):
                break
        reach = max([k + 1 for k, (p, _) in enumerate(found) if len(p)], default=1)
        ids = np.full((count, n + 1, reach), self.none, np.int32)
        for k, (p, piece) in enumerate(found[:reach]):
            ids[p // n, p % n + k + 1, k] = piece
        w, j = np.nonzero(ids[:, 1:, 0] == self.none)
        extra, at = np.unique(codes[w, j], return_inverse=True)
        ids[w, j + 1, 0] = self.none + 1 + at
        return ids, {self.none + 1 + x: [int(self.v.as_byte[b]) for b in chr(int(c)).encode()] for x, c in enumerate(extra)}

    def _weights(self, spelled: dict[int, list[int]]) -> np.ndarray:
        """Log probability by id; none has none."""
        return np.concatenate([self.logp, [-np.inf], [self.logp[v].sum() for v in spelled.values()]])

    @staticmethod
    def _groups(words: list[str]) -> Iterator[np.ndarray]:
        size = np.array([len(w) for w in words])
        order = np.argsort(size, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            step = max(1, 30_000 // (size[part[0]] + 2)) if len(part) else 1
            yield from (part[i : i + step] for i in range(0, len(part), step))

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """The log probability of each word: the sum over all its segmentations, by the forward recursion in log space."""
        out = np.empty(len(words))
        for part in self._groups(words):
            ids, spelled = self._arcs([words[i] for i in part])
            out[part] = self._forward(self._weights(spelled)[ids])[:, -1]
        return out

    @staticmethod
    def _forward(arc: np.ndarray) -> np.ndarray:
        count, n1, reach = arc.shape
        f = np.full((count, n1), -np.inf)
        f[:, 0] = 0
        for j in range(1, n1):
            k = min(j, reach)
            x = f[:, j - k : j][:, ::-1] + arc[:, j, :k]
            top = x.max(1)
            f[:, j] = top + np.log(np.exp(x - top[:, None]).sum(1))
        return f

    def expected(self, words: list[str], weight: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces over the segmentations of words, each word counting with its weight.

        Forward and backward sums are of probabilities, scaled by the forward sums' maximum at every step."""
        counts = np.zeros(len(self.logp))
        for part in self._groups(words):
            ids, spelled = self._arcs([words[i] for i in part])
            logs = self._weights(spelled)
            count, n1, reach = ids.shape
            f = self._forward(logs[ids])
            w, j, k = np.nonzero(ids != self.none)  # few of the places hold a piece
            i, own = j - k - 1, ids[w, j, k]
            # what an arc adds to the forward sum where it ends: backward, these shares pass a word's weight on
            share = np.exp(f[w, i] + logs[own] - f[w, j])
            back = np.zeros((count, n1))
            back[:, -1] = weight[part]
            order = np.argsort(-j, kind="stable")
            w, i, j, own, share = w[order], i[order], j[order], own[order], share[order]
            edge = np.flatnonzero(np.diff(j)) + 1
            for lo, hi in zip([0, *edge], [*edge, len(j)]):
                mass = back[w[lo:hi], j[lo]] * share[lo:hi]
                share[lo:hi] = mass
                np.add.at(back, (w[lo:hi], i[lo:hi]), mass)
            flat = np.bincount(own, share, len(logs))
            counts += flat[: len(counts)]
            for x, spelling in spelled.items():
                np.add.at(counts, spelling, flat[x])
        return counts


def _batches(it: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for b in it:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _together(it: Iterator[pa.RecordBatch], rows: int = 20_000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many rows or bytes: the lattice takes words of one length at a time, of
    which a batch as small as texts need has few."""
    held, n, weight = [], 0, 0
    for b in it:
        held.append(b)
        n, weight = n + b.num_rows, weight + b.nbytes
        if n >= rows or weight >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, weight = [], 0, 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def token_counts(rows: DataFrame, most: int = 400_000) -> DataFrame:
    """(token, c, n): every distinct token of rows (train boolean, text), how often it occurs in training texts and in
    all. Tasks add up what they see, and pass it on whenever they hold `most` tokens."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {True: Counter(), False: Counter()}

        def out() -> pa.RecordBatch:
            t, f = seen[True], seen[False]
            keys = list(t.keys() | f.keys())
            c = [t.get(k, 0) for k in keys]
            n = [x + f.get(k, 0) for x, k in zip(c, keys)]
            t.clear(), f.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], ["token", "c", "n"])

        for b in _batches(it, 500):
            data, at = utf8(b.column("text"))
            raw = data.tobytes().translate(LOWER)
            for train, lo, hi in zip(b.column("train").to_pylist(), at[:-1], at[1:]):
                seen[bool(train)].update(raw[lo:hi].split())
                if len(seen[True]) + len(seen[False]) > most:
                    yield out()
        yield out()

    return rows.select("train", "text").mapInArrow(count, "token binary, c long, n long").groupBy("token").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fitted(words: DataFrame, ends: int, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces, and of the end of a text, after rounds of expectation maximisation over words
    (token, c: how often), from the vocabulary's own weights. The driver sees one number for each piece."""
    logp = vocabulary(path).start
    for _ in range(rounds):
        sent = words.sparkSession.sparkContext.broadcast(logp)

        def expect(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(vocabulary(path), sent.value)  # noqa: B023
            total = np.zeros(len(lattice.logp))
            for b in _batches(_together(it)):
                total += lattice.expected([x.decode("utf-8", "replace") for x in b.column("token").to_pylist()], b.column("c").to_numpy().astype(float))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["piece", "x"])

        got = words.select("token", "c").mapInArrow(expect, "piece int, x double").groupBy("piece").agg(F.sum("x").alias("x")).toArrow()
        x = np.full(len(logp), 0.01)
        x[got["piece"].to_numpy()] += got["x"].to_numpy()
        x[-1] += ends
        logp = np.log(x / x.sum())
    return logp


def lm_scores(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score.

    Tokens are words (A-Z lowered) and one end per text. base_score is the smoothed unigram score of the training
    texts, those whose hashed id leaves no 0 by 10. score is the log10 probability of the text under the subword
    lattice: a text is a sequence of pieces and an end, drawn one by one, and all segmentations of its words are
    summed. In mixed_score a word is, with the chance 1 - hapaxes / N, drawn whole from the training tokens, and else
    spelled on the lattice. Null texts are empty (one end); a null id is a training text; repeated rows are scored and
    counted each; other columns are ignored; an empty table gives an empty result. Very long texts and words are taken
    whole. Without training texts the vocabulary's own weights are used.

    Counts of distinct tokens and their lattice scores are made once per distinct token, over the whole corpus. Texts
    are read twice and never moved: tokens that are frequent in the whole corpus, held-out texts included, are scored
    in place, and a row for each other distinct token of a text meets its counts by a join. Rows are told apart by
    their place in docs, so docs must be read in the same order when a task runs again."""
    spark = docs.sparkSession
    ship(spark)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), (~held).alias("train"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = stored(token_counts(rows), "counts")
    ends = rows.where("train").count()
    sums = counts.agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("once")).first()
    total, distinct, once = (sums.c or 0) + ends, (sums.v or 0) + (ends > 0), sums.once or 0
    known = 1 - max(once, 1) / total if total > 1 else 0.0
    logp = fitted(counts.where("c > 0"), ends, path, rounds)
    sent = spark.sparkContext.broadcast(logp)

    def spell(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(path), sent.value)
        for b in _batches(_together(it)):
            c = b.column("c").to_numpy()
            spelled = lattice.log_likelihoods([x.decode("utf-8", "replace") for x in b.column("token").to_pylist()])
            with np.errstate(divide="ignore"):
                mixed = np.logaddexp(spelled + math.log(1 - known), np.log(known * c / max(total, 1)))
            yield pa.RecordBatch.from_arrays([b.column("token"), b.column("c"), b.column("n"), pa.array(spelled / math.log(10)), pa.array(mixed / math.log(10))], ["token", "c", "n", "lp", "mp"])

    words = stored(counts.mapInArrow(spell, "token binary, c long, n long, lp double, mp double"), "words")
    least = max(1.0, HEAD_SHARE * (sums.n or 0))
    head = words.where(F.col("n") >= least).toArrow()
    frequent = spark.sparkContext.broadcast(dict(zip(head["token"].to_pylist(), zip(head["c"].to_pylist(), head["lp"].to_pylist(), head["mp"].to_pylist()))))
    floor = math.log10(total + 0.1 * (distinct + 1))
    end_base = math.log10(ends + 0.1) - floor
    end_score = logp[-1] / math.log(10)
    end_mixed = math.log10((1 - known) * math.exp(logp[-1]) + (known * ends / total if total else 0))

    def sift(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("token", pa.binary()), ("m", pa.int64())])
        for b in _batches(it, 500):
            data, at = utf8(b.column("text"))
            raw = data.tobytes().translate(LOWER)
            get = frequent.value.get
            n, seen, rest, sums = [], [], [], []
            for lo, hi in zip(at[:-1], at[1:]):
                bag = Counter(raw[lo:hi].split())
                k, x, y, z, tail = int(ends > 0), end_base, end_score, end_mixed, []
                for t, m in bag.items():
                    if h := get(t):
                        k += m if h[0] else 0
                        x += m * (math.log10(h[0] + 0.1) - floor)
                        y += m * h[1]
                        z += m * h[2]
                    else:
                        tail.append({"token": t, "m": m})
                n.append(bag.total() + 1), seen.append(k), sums.append((x, y, z)), rest.append(tail)
            cols = [b.column("row"), b.column("doc_id"), b.column("held_out"), pa.array(n, pa.int64()), pa.array(seen, pa.int64()), *(pa.array([x[k] for x in sums], pa.float64()) for k in range(3)), pa.array(rest, pa.list_(kind))]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "mixed", "tail"])

    id_kind = dict(rows.dtypes)["doc_id"]
    shape = f"row long, doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, base double, score double, mixed double, tail array<struct<token: binary, m: long>>"
    sifted = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(sift, shape)
    parts = sifted.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "mixed", F.posexplode_outer("tail").alias("k", "t"))
    first = F.coalesce(F.col("k") == 0, F.lit(True))
    own = [F.when(first, F.col(c)).otherwise(0).alias(c) for c in ("n_tokens", "n_known", "base", "score", "mixed")]
    # a text without such tokens gets a token of its own that meets nothing
    token = F.coalesce(F.col("t.token"), F.concat(F.lit(" "), F.col("row").cast("string")).cast("binary")).alias("token")
    parts = parts.select("row", "doc_id", "held_out", *own, token, F.coalesce("t.m", F.lit(0)).alias("m"))
    met = parts.join(words.where(F.col("n") < least).drop("n"), "token", "left")
    sums = met.groupBy("row", "doc_id", "held_out").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(F.col("c").isNotNull(), F.col("m") * (F.log10(F.col("c") + 0.1) - floor)).otherwise(0.0)).alias("base_score"),
        F.sum(F.col("score") + F.coalesce(F.col("m") * F.col("lp"), F.lit(0.0))).alias("score"),
        F.sum(F.col("mixed") + F.coalesce(F.col("m") * F.col("mp"), F.lit(0.0))).alias("mixed_score"),
    )
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "mixed_score")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), model_path())
