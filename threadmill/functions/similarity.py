"""String similarities from 0 to 100, as pandas UDFs over distinct candidate pairs: a batch of pairs is compared at once,
a character a step, with one machine word for each pair or window."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession, functions as F

from ..operators.store import ship


#: How alike two names of one node are: by their best window, or by their words.
PARTIAL, TOKENS = 80.0, 75.0


def indel(a: str, b: str) -> float:
    """200 * (longest common subsequence) / (both lengths), by bit vectors."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return 200.0 * (len(a) - v.bit_count()) / (len(a) + len(b))


def best_window(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of its length in the longer, windows cut at the ends too."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    return max(indel(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def token_sets(a: str, b: str) -> float:
    """The best ratio among the sorted common words and these with either side's own words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    if common and (x <= y or y <= x):
        return 100.0
    one, two = (f"{common} {' '.join(sorted(s))}".strip() for s in (x - y, y - x))
    return max([indel(one, two), *((indel(common, s) for s in (one, two)) if common else ())])


def same_node(a: str, b: str) -> bool:
    """Equal, or the same digits and alike enough."""
    digits = lambda s: set(re.findall(r"\d+", s))
    return a == b or digits(a) == digits(b) and (best_window(a, b) >= PARTIAL or token_sets(a, b) >= TOKENS)


#: Characters that a word has bits for; pairs whose shorter string is longer are compared one by one.
BITS = 64
#: Characters by characters of a block of pairs that are compared at once, about.
CELLS = 1 << 22


def _matrix(strings: list[str]) -> np.ndarray:
    """Code points by string and place, 0 beyond the end."""
    width = max(1, max(map(len, strings)))
    return np.array(strings, dtype=f"<U{width}").view(np.uint32).reshape(len(strings), width)


def _masks(short: list[str], long: list[str]) -> np.ndarray:
    """By pair and place in long: the places in short that have its character, as bits."""
    a, b = _matrix(short), _matrix(long)
    n, m = (np.array([len(x) for x in xs]) for xs in (short, long))
    same = (a[:, None, :] == b[:, :, None]) & (np.arange(a.shape[1]) < n[:, None])[:, None, :] & (np.arange(b.shape[1]) < m[:, None])[:, :, None]
    bits = np.zeros((*same.shape[:2], BITS // 8), np.uint8)
    packed = np.packbits(same, axis=2, bitorder="little")
    bits[:, :, : packed.shape[2]] = packed
    return bits.view("<u8")[:, :, 0]


def _blocks(order: np.ndarray, cells: np.ndarray):
    """order in runs of about CELLS cells, one pair at least."""
    upto = np.cumsum(cells[order])
    lo = 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CELLS, "right")))
        yield order[lo:hi]
        lo = hi


def _sides(a: list[str], b: list[str]) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """The shorter and the longer of each pair, and their lengths."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    short, long = [x for x, _ in pairs], [y for _, y in pairs]
    return short, long, np.array([len(x) for x in short], np.int64), np.array([len(y) for y in long], np.int64)


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """indel of every pair."""
    short, long, n, m = _sides(a, b)
    out = np.zeros(len(short))
    out[(n == 0) & (m == 0)] = 100.0
    for i in np.flatnonzero(n > BITS):
        out[i] = indel(short[i], long[i])
    some = np.flatnonzero((n > 0) & (n <= BITS))
    for block in _blocks(some[np.argsort(m[some], kind="stable")], (n + 1) * m):
        masks = _masks([short[i] for i in block], [long[i] for i in block])
        full = np.uint64(2**64 - 1) >> (BITS - n[block]).astype(np.uint64)
        v = full.copy()
        for t in range(masks.shape[1]):
            u = v & masks[:, t]
            v = (v + u) | (v - u)
        common = n[block] - np.bitwise_count(v & full)
        out[block] = 200.0 * common / (n[block] + m[block])
    return out


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """best_window of every pair. Pairs whose shorter strings are equally long are compared together, with a word for
    each window; windows share what is known of the longer string's characters."""
    short, long, n, m = _sides(a, b)
    out = np.zeros(len(short))
    out[(n == 0) & (m == 0)] = 100.0
    for i in np.flatnonzero(n > BITS):
        out[i] = best_window(short[i], long[i])
    for size in np.unique(n[(n > 0) & (n <= BITS)]):
        some = np.flatnonzero(n == size)
        for block in _blocks(some[np.argsort(m[some], kind="stable")], (m + size) * size):
            masks = _masks([short[i] for i in block], [long[i] for i in block])
            width = masks.shape[1]
            masks = np.pad(masks, ((0, 0), (size - 1, size)))
            windows = width + size - 1  # the first has one character of long, at its end
            full = np.uint64(2**64 - 1) >> np.uint64(BITS - size)
            v = np.full((len(block), windows), full)
            for t in range(size):
                at = masks[:, t : t + windows]
                u = v & at
                v = (v + u) | (v - u)
            common = size - np.bitwise_count(v & full).astype(np.int64)
            start = np.arange(windows) - (size - 1)
            length = np.minimum(start + size, m[block][:, None]) - np.maximum(start, 0)
            score = np.where(length > 0, 200.0 * common / (size + np.maximum(length, 1)), 0.0)
            out[block] = score.max(axis=1)
    return out


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """token_sets of every pair: its strings are made one by one, and compared together."""
    out = np.zeros(len(a))
    left, right, of = [], [], []
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = set(x.split()), set(y.split())
        if not x or not y:
            continue
        both = x & y
        if both and len(both) in (len(x), len(y)):
            out[i] = 100.0
            continue
        common = " ".join(sorted(both))
        one, two = (f"{common} {' '.join(sorted(s - both))}".strip() for s in (x, y))
        more = [(one, two), *(((common, one), (common, two)) if common else ())]
        left += [p for p, _ in more]
        right += [q for _, q in more]
        of += [i] * len(more)
    if of:
        np.maximum.at(out, np.array(of), ratios(left, right))
    return out


def node_matches(a: list[str], b: list[str]) -> np.ndarray:
    """same_node of every pair."""
    number = re.compile(r"\d+")
    out = np.array([x == y for x, y in zip(a, b)], bool)
    for score, least in ((partial_ratios, PARTIAL), (token_set_ratios, TOKENS)):
        rest = [i for i in np.flatnonzero(~out) if set(number.findall(a[i])) == set(number.findall(b[i]))]
        if rest:
            out[rest] = score([a[i] for i in rest], [b[i] for i in rest]) >= least
    return out


def _udf(f, kind):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        there = (a.notna() & b.notna()).to_numpy()
        out = pd.Series([None] * len(a), dtype=object)
        if there.any():
            out[there] = list(f(a[there].tolist(), b[there].tolist()))
        return out

    return F.pandas_udf(run, kind)


def udfs() -> dict[str, object]:
    """For the active session: ratio, partial_ratio, token_set_ratio and node_match as column functions."""
    ship(SparkSession.active())
    return {"ratio": _udf(ratios, "double"), "partial_ratio": _udf(partial_ratios, "double"), "token_set_ratio": _udf(token_set_ratios, "double"), "node_match": _udf(node_matches, "boolean")}
