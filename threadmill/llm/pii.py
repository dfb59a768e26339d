"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes that adds spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship, spans, table, utf8

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = 0  # label of words that are no personal data
LABELS = 1 + 2 * len(KINDS)  # kind k begins with label 1 + 2 * k and goes on with the next one

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match can't start inside a run of digits that another start takes whole, so runs are tried once
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern: around each @ the longest run of local characters and a domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four patterns, by kind and start; matches that fail their test are dropped."""
    out = [("email", s, e) for s, e in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# ---- the field -------------------------------------------------------------------------------------------------

#: Values that the labelled table and its held-out sisters are filled with.
NAMES, HOSTS, ENDS = "ana bob j-d mia tom.w k_lee info sales r2 zoe+x".split(), "mail post uni host shop data-x web4 corp".split(), "org com net example de fr io edu".split()
WORDS = "the of and server went down Please write to me now soon Order number is late La casa de los und der die eine Le chat est noir page Section figure NOTE total cost was it, (see) end. about; Where? call card again".split()
#: Personal data by kind, most of it in forms that the base patterns miss: # a digit, @ a local part, h a host, t its end,
#: o a number of up to 255, C a card number. Parts of a form stand between bars.
FORMS = {
    "email": "@ (at) h.t|@(at)h.t|@[at]h.t|@ [at] h [dot] t|@(at)h(dot)t|@[at]h[dot]t|@ at|@@h|@@h.t",
    "ip": "o.o.o.o|o[.]o[.]o[.]o|o(.)o(.)o(.)o|o[dot]o[dot]o[dot]o|o.o.o.o:####|o.o.o.o/##",
    "card": "C16|C15|C4-4-4-4|C4 4 4 4|C4.4.4.4|C4/4/4/4",
    "phone": "+# (###) ###-####|+## ## #### ####|+##-##-######|(###) ###-####|(###)###-####|###-###-####|###.###.####|+#.###.###.####",
}
#: What is no personal data though it has digits or marks; X a card number with a wrong check digit, x a hexadecimal digit.
OTHERS = "####|##.#|#.#.#|#,###|##%|####-##-##|##:##|##-##|X16|X4-4-4-4|xxxxxxxxxxxxxxxx|\"xxxxxxxxxxxx\"|#.|###.|####.#.###.#|$##.##|@name|a @ b|##x##|v#.#.#|#####|######|##/##/####|(####)|[##]|#-#|###.###.#.#|key=xxxxxxxx|§#.#.#.#.#|############"


def _card(rng: np.random.Generator, right: bool, size: int = 16) -> str:
    digits = "".join(map(str, rng.integers(0, 10, size - 1)))
    return digits + next(c for c in "0123456789" if luhn(digits + c) == right)


def _filled(form: str, rng: np.random.Generator) -> str:
    pick = lambda x: x[rng.integers(len(x))]
    if form[0] in "CX":
        sizes = re.findall(r"\d+", form)
        number, out = _card(rng, form[0] == "C", sum(map(int, sizes))), ""
        for part in re.findall(r"\d+|\D", form[1:]):
            out, number = (out + number[: int(part)], number[int(part) :]) if part.isdigit() else (out + part, number)
        return out
    if form in OTHERS.split("|"):
        return re.sub("[#x]", lambda m: pick("0123456789" if m[0] == "#" else "0123456789abcdef"), form)
    out = form.replace("@@", "\0").replace("@", "\1", 1).replace("\0", "\1\2")
    fill = {"#": lambda: pick("0123456789"), "o": lambda: str(rng.integers(256)), "h": lambda: pick(HOSTS), "t": lambda: pick(ENDS), "\1": lambda: pick(NAMES), "\2": lambda: "@"}
    hide = re.split(r"(\(at\)|\[at\]|\(dot\)|\[dot\])", out)
    return "".join(x if k % 2 else "".join(fill[c]() if c in fill else c for c in x) for k, x in enumerate(hide))


def labelled_rows(n: int, seed: int) -> list[tuple[list[str], list[int]]]:
    """The labelled table: n sentences as words and their labels, of noise words, personal data in many forms, numbers
    that are none, and marks at the edges of words. All invented; the same for a seed everywhere."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        words, labels = [], []
        for _ in range(rng.integers(1, 5)):
            for _ in range(rng.integers(0, 6)):
                words.append(WORDS[rng.integers(len(WORDS))])
                labels.append(OUTSIDE)
            kind = int(rng.integers(-4, len(KINDS)))
            forms = (FORMS[KINDS[kind]] if kind >= 0 else OTHERS).split("|")
            form = forms[rng.integers(len(forms))]
            if form == "@ at":  # a name before a word is none
                kind = -1
            own = (_filled(form, rng) if form != "@ at" else "bob at home").split()
            if rng.random() < 0.3:
                own[-1] += ".,;:!?)"[rng.integers(7)]
            if rng.random() < 0.1:
                own[0] = "(<\"'"[rng.integers(4)] + own[0]
            words += own
            labels += [OUTSIDE] * len(own) if kind < 0 else [1 + 2 * kind] + [2 + 2 * kind] * (len(own) - 1)
        out.append((words, labels))
    return out


_PIECE = re.compile(r"\S+")
_EDGE = " .,;:!?\"'<>*$&%#|=~`"
_MARKED = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]")
REACH = 2  # features of so many words to either side count as well


def features(word: str) -> list[str]:
    """The shape of a word: letters as X and x, digits as d, runs of one class as one; the same with the lengths of runs
    of digits, its first and last three signs, how long it is and how many digits it has, which marks are at its
    edges, and whether its digits can be those of an address or a card. Of words without digits or marks of personal
    data, only their case."""
    core = word.strip(_EDGE)
    if not _MARKED.search(core):
        return ["plain " + re.sub(r"[^Xx]+", ".", re.sub(r"[^\W\dA-Z_]+", "x", re.sub(r"[A-Z]+", "X", word[:2])))]
    hidden = re.sub(r"[\[(](at|dot)[\])]", lambda m: "\1" if m[1] == "at" else "\2", core)
    shape = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0].isupper() else "x", hidden).replace("\1", "<at>").replace("\2", "<dot>")
    coarse = re.sub(r"[0-9]+", "d", shape)
    fine = re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 5)}", shape)
    digits = _digits(core)
    groups = re.findall(r"[0-9]+", core)
    octets = len(groups) >= 4 and all(len(x) <= 3 and int(x) <= 255 for x in groups[:4])
    card = 13 <= len(digits) <= 19 and (1 + luhn(digits))
    edges = f"{word[0] if word[0] in _EDGE else ''}_{word[-1] if word[-1] in _EDGE else ''}"
    mixed = "hex" if re.fullmatch(r"[0-9a-fA-F]{7,}", core) and not core.isdigit() else ""
    return [f"s {coarse[:24]}", f"f {fine[:24]}", f"< {coarse[:3]}", f"> {coarse[-3:]}", f"l {min(len(core), 30) // 3}", f"n {min(len(digits), 20)}", f"e {edges}", f"o {octets}", f"c {card}", f"g {len(groups)}", f"h {mixed}"]


class Field:
    """A linear-chain conditional random field over word shapes: weights of features by offset and label, and of moves."""

    def __init__(self, names: list[str], emit: np.ndarray, move: np.ndarray):
        self.number, self.emit, self.move = {x: k for k, x in enumerate(names)}, emit, move
        self.known: dict[str, np.ndarray] = {}

    def weights(self, word: str) -> np.ndarray:
        """Offsets x labels: what a word adds to the scores of the words around it."""
        found = self.known.get(word)
        if found is None:
            own = [self.number[x] for x in features(word) if x in self.number]
            found = self.emit[:, own].sum(1)
            if len(self.known) < 100_000:
                self.known[word] = found
        return found

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores (words x labels) of a chain."""
        every = np.array([self.weights(w) for w in words]).reshape(len(words), 2 * REACH + 1, LABELS)
        out = np.zeros((len(words), LABELS))
        for d in range(2 * REACH + 1):  # the word d - REACH places on
            shift = d - REACH
            lo, hi = max(0, -shift), min(len(words), len(words) - shift)
            if lo < hi:
                out[lo:hi] += every[lo + shift : hi + shift, d]
        return out


def _expected(e: np.ndarray, move: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over padded chains (chains x steps x labels): marginals, expected moves, sum of log partitions."""
    n, steps, k = e.shape
    inside = np.arange(steps)[None, :] < size[:, None]
    chance = np.exp(move)

    def onward(x: np.ndarray, moves: np.ndarray) -> np.ndarray:
        """log(exp(x) @ moves), row by row."""
        top = x.max(1, keepdims=True)
        return np.log(np.exp(x - top) @ moves) + top

    f, b = np.zeros_like(e), np.zeros_like(e)
    f[:, 0] = e[:, 0]
    for t in range(1, steps):
        f[:, t] = np.where(inside[:, t, None], onward(f[:, t - 1], chance) + e[:, t], f[:, t - 1])
    last = f[:, -1]
    z = np.log(np.exp(last - last.max(1, keepdims=True)).sum(1)) + last.max(1)
    for t in range(steps - 2, -1, -1):
        b[:, t] = np.where(inside[:, t + 1, None], onward(e[:, t + 1] + b[:, t + 1], chance.T), b[:, t + 1])
    p = np.exp(f + b - z[:, None, None]) * inside[..., None]
    moves = np.zeros_like(move)
    for t in range(1, steps):
        top = f[:, t - 1].max(1, keepdims=True)
        moves += chance * (np.exp(f[:, t - 1] - top).T @ (np.exp(e[:, t] + b[:, t] + top - z[:, None]) * inside[:, t, None]))
    return p, moves, float(z.sum())


def fit(rows: list[tuple[list[str], list[int]]], steps: int = 100, penalty: float = 0.02) -> Field:
    """Maximum likelihood with a penalty on the squares of weights, by gradient ascent with a step for each weight."""
    vocabulary: dict[str, int] = {}
    word = [[vocabulary.setdefault(w, len(vocabulary)) for w in ws] for ws, _ in rows]
    names: dict[str, int] = {}
    own = [[names.setdefault(x, len(names)) for x in features(w)] for w in vocabulary]
    flat, of = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
    size = np.array([len(w) for w in word])
    pad = len(vocabulary)
    ids = np.full((len(rows), size.max() + 2 * REACH), pad)
    label = np.zeros((len(rows), size.max()), int)
    for r, (ws, (_, ls)) in enumerate(zip(word, rows)):
        ids[r, REACH : REACH + len(ws)] = ws
        label[r, : len(ls)] = ls
    inside = np.arange(size.max())[None, :] < size[:, None]
    seen = np.zeros((LABELS, LABELS))
    np.add.at(seen, (label[:, :-1][inside[:, 1:]], label[:, 1:][inside[:, 1:]]), 1.0)
    truth = np.eye(LABELS)[label] * inside[..., None]
    emit, move = np.zeros((2 * REACH + 1, len(names), LABELS)), np.zeros((LABELS, LABELS))
    size_e, size_m = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)

    def summing(key: np.ndarray, n: int):
        """A function that adds up rows by key, each of 0 to n - 1 occurring."""
        order = np.argsort(key, kind="stable")
        at = np.searchsorted(key[order], np.arange(n))
        return lambda rows: np.add.reduceat(rows[order], at)

    to_word, to_feature = summing(of, pad), summing(flat, len(names))
    views = [ids[:, d : d + label.shape[1]] for d in range(2 * REACH + 1)]
    # one more row for each word, so that all occur
    by_word = [summing(np.concatenate([v.ravel(), np.arange(pad + 1)]), pad + 1) for v in views]
    for _ in range(steps):
        every = [np.vstack([to_word(x[flat]), np.zeros(LABELS)]) for x in emit]
        p, moves, _ = _expected(sum(x[v] for x, v in zip(every, views)), move, size)
        want = np.vstack([(truth - p).reshape(-1, LABELS), np.zeros((pad + 1, LABELS))])
        ge = np.stack([to_feature(f(want)[of]) for f in by_word]) - penalty * emit
        gm = seen - moves - penalty * move
        size_e += ge**2
        size_m += gm**2
        emit += 0.3 * ge / np.sqrt(size_e)
        move += 0.3 * gm / np.sqrt(size_m)
    return Field(list(names), emit, move)


@cache
def trained(n: int = 1000, seed: int = 1) -> Field:
    """The field, fitted to a labelled table of n sentences: the same everywhere."""
    return fit(labelled_rows(n, seed))


def viterbi(emit: np.ndarray, move: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best label sequences of many chains at once. emit: chains x steps x labels, padded."""
    n, steps, k = emit.shape
    best, back = emit[:, 0], np.zeros((n, steps, k), np.int8)
    last = np.where((lengths == 1)[:, None], best, 0.0)
    for t in range(1, steps):
        step = best[:, :, None] + move[None]
        back[:, t] = step.argmax(1)
        best = step.max(1) + emit[:, t]
        last = np.where((lengths == t + 1)[:, None], best, last)
    out = np.zeros((n, steps), np.int8)
    label = last.argmax(1).astype(np.int8)
    for t in range(steps - 1, -1, -1):
        inside = t < lengths
        out[inside, t] = label[inside]
        label = np.where(inside & (t > 0), back[np.arange(n), t, label], label)
    return out


def decode(field: Field, texts: list[str], words: list[list[tuple[int, int]]], batch: int = 512) -> list[np.ndarray]:
    """Labels of the words of each text, by Viterbi. Plain words without a digit or mark of personal data within REACH
    words are outside, whatever the field says, so that chains can be cut at them; the stretches between are decoded in
    padded batches of like length."""
    chains, out = [], []
    for i, (text, ws) in enumerate(zip(texts, words)):
        marked = np.array([_MARKED.search(text, s, e) is not None for s, e in ws], bool)
        out.append(np.zeros(len(ws), np.int8))
        if not marked.any():
            continue
        near = np.convolve(marked, np.ones(2 * REACH + 1), "full")[REACH : REACH + len(ws)] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], near.astype(int), [0]])))
        for lo, hi in zip(edge[::2], edge[1::2]):
            a, z = max(0, lo - REACH), min(len(ws), hi + REACH)
            own = field.scores([text[s:e] for s, e in ws[a:z]])[lo - a : hi - a]
            if lo:  # the words at both sides are outside
                own[0] += field.move[OUTSIDE]
            if hi < len(ws):
                own[-1] += field.move[:, OUTSIDE]
            chains.append((i, lo, own))
    chains.sort(key=lambda c: len(c[2]))
    for at in range(0, len(chains), batch):
        some = chains[at : at + batch]
        lengths = np.array([len(c[2]) for c in some])
        emit = np.zeros((len(some), lengths.max(), LABELS))
        for k, c in enumerate(some):
            emit[k, : len(c[2])] = c[2]
        for (i, lo, own), labels in zip(some, viterbi(emit, field.move, lengths)):
            out[i][lo : lo + len(own)] = labels[: len(own)]
    return out


def _fits(kind: str, found: str) -> bool:
    """Whether a span can be of its kind at all."""
    n = len(_digits(found))
    if kind == "email":
        return re.search(r"@|[\[(]at[\])]", found) is not None
    if kind == "ip":
        x = re.findall(r"[0-9]+", found)
        return len(x) >= 4 and all(len(v) <= 3 and int(v) <= 255 for v in x[:4])
    return 13 <= n <= 19 and luhn(_digits(found)) if kind == "card" else 9 <= n <= 15


def added_spans(text: str, words: list[tuple[int, int]], labels: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of labelled words that no base span touches and that can be of their kind: from a word that begins one, or
    goes on with a kind that none before has, to the last word that goes on with it."""
    taken = sorted((s, e) for _, s, e in base)
    out, k = [], 0
    while k < len(words):
        label = int(labels[k])
        if label == OUTSIDE:
            k += 1
            continue
        j = k + 1
        kind = (label - 1) // 2
        while j < len(words) and labels[j] == 2 + 2 * kind:
            j += 1
        start, end = words[k][0], words[j - 1][1]
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and (text[end - 1] in _EDGE or text[end - 1] == ")" and "(" not in text[start:end]):
            end -= 1
        if start < end and _fits(KINDS[kind], text[start:end]) and not any(s < end and start < e for s, e in taken):
            out.append((KINDS[kind], start, end))
        k = j
    return out


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(found, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


_MARKS = np.zeros(256, bool)
_MARKS[[ord("@"), *range(48, 58)]] = True


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans.

    The counts by kind and the digest are of the base patterns; spans has these and what the field adds, n_spans their
    number. The field is fitted on the driver to its small labelled table, and sent to the tasks. Null and empty texts
    have none; repeated rows and null ids are handled row by row; other columns are ignored. Whole texts are read
    where they lie, nothing is shuffled, and what a task holds is bounded by a batch's text."""
    ship(docs.sparkSession)
    nothing = hashlib.sha256(b"").hexdigest()
    field = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("text"))
            ids = batch.column("doc_id")
            for lo, hi in spans(at):
                here = at[lo : hi + 1] - at[lo]
                part = data[at[lo] : at[hi]]
                seen = np.flatnonzero(_MARKS[part] | (part == ord("(")) | (part == ord("[")))
                rows = np.unique(np.searchsorted(here, seen, "right") - 1)
                texts = [bytes(part[here[r] : here[r + 1]]).decode() for r in rows]
                words = [[m.span() for m in _PIECE.finditer(t)] for t in texts]
                n = hi - lo
                counts, base_sha, every, added = np.zeros((4, n), np.int64), [nothing] * n, [""] * n, np.zeros(n, np.int64)
                for r, text, ws, labels in zip(rows, texts, words, decode(field.value, texts, words)):
                    base = base_spans(text)
                    more = added_spans(text, ws, labels, base)
                    for k, name in enumerate(KINDS):
                        counts[k, r] = sum(x[0] == name for x in base)
                    base_sha[r], every[r], added[r] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi], *map(pa.array, counts), pa.array(base_sha), pa.array(every), pa.array(added), pa.array(counts.sum(0) + added)],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"],
                )

    rows = docs.selectExpr(f"`{id_col}` as doc_id", f"coalesce(`{text_col}`, '') as text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redacted(text: str, found: str) -> str:
    """text with every span of a joined list replaced by its kind."""
    out, end = [], 0
    for kind, s, e in sorted(((k, int(s), int(e)) for k, s, e in (x.split(":") for x in found.split(",") if x)), key=lambda x: x[1]):
        if s >= end:
            out += [text[end:s], f"<{kind}>"]
            end = e
    return "".join(out) + text[end:]


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (id, text) with the spans of each text replaced by their kinds."""
    ship(docs.sparkSession)
    field = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].fillna("").tolist()
            words = [[m.span() for m in _PIECE.finditer(t)] for t in texts]
            done = []
            for t, ws, labels in zip(texts, words, decode(field.value, texts, words)):
                base = base_spans(t)
                done.append(redacted(t, joined(base + added_spans(t, ws, labels, base))))
            yield pdf.assign(text=done)

    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInPandas(run, f"doc_id {dict(docs.dtypes)[id_col]}, text string")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))
