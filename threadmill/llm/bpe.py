"""Byte-level BPE: overlapping chunks are pre-tokenised and encoded in parallel and stitched where they agree."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ship, small, stored, table

#: A longer text is cut into chunks of this many code points, which overlap by OVERLAP.
CHUNK, OVERLAP = 16384, 1024
#: A boundary so close to a chunk's cut end may depend on what follows the cut.
MARGIN = 4


@cache
def encoder(path: str):
    """The tiktoken encoding of a rank file, the bytes of each id and its decimal digits; read once in each worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    return encoding, pieces, [str(i) for i in range(len(pieces))]


def boundaries(window: str, last: bool) -> list[int]:
    """Starts of the pre-tokens of window that can be stitched: a non-space stands before, so that a text cut there
    splits as the whole text does, and the decision doesn't depend on what follows the window."""
    import public_tokenizers
    import regex

    end = len(window) + 1 if last else len(window) - MARGIN
    starts = (m.start() for m in regex.finditer(public_tokenizers.PATTERN, window))
    return [p for p in starts if 0 < p < end and not window[p - 1].isspace()]


Finish = Callable[[np.ndarray, list[bytes], list[str]], tuple]


def as_text(ids: np.ndarray, pieces: list[bytes], digits: list[str]) -> tuple[str, bytes]:
    """ids as decimals joined by commas, and the bytes that they decode to."""
    ids = ids.tolist()
    return ",".join(map(digits.__getitem__, ids)), b"".join(map(pieces.__getitem__, ids))


def digests(ids: np.ndarray, pieces: list[bytes], digits: list[str]) -> tuple[str, str]:
    """SHA-256 of both parts of as_text, from slices of the ids."""
    listed, decoded = hashlib.sha256(), hashlib.sha256()
    for lo in range(0, len(ids), 1 << 16):
        text, raw = as_text(ids[lo : lo + (1 << 16)], pieces, digits)
        listed.update((b"," if lo else b"") + text.encode())
        decoded.update(raw)
    return listed.hexdigest(), decoded.hexdigest()


TEXT, DIGESTS = "ids string, decoded binary", "ids_sha256 string, decoded_sha256 string"


def encode_texts(texts: DataFrame, keys: list[str], path: str, text_col: str = "text", finish: Finish = as_text, shape: str = TEXT) -> DataFrame:
    """keys, n (ids) and what finish makes of the ids of each text: ids and decoded bytes, or digests of both."""
    ship(texts.sparkSession)
    kinds = ", ".join(f"{k} {t}" for k, t in texts.select(*keys).dtypes)
    names = [x.split()[0] for x in shape.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, pieces, digits = encoder(path)
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                ids = [np.array(encoding.encode_ordinary(t), np.uint32) for t in part[text_col]]
                done = zip(*(finish(x, pieces, digits) for x in ids))
                yield part[keys].assign(n=list(map(len, ids)), **dict(zip(names, map(list, done))))

    return texts.select(*keys, text_col).mapInPandas(run, f"{kinds}, n long, {shape}")


def encode_long_texts(texts: DataFrame, path: str, finish: Finish = as_text, shape: str = TEXT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n and what finish makes of the ids of each long text (row, doc_id, text); row is unique.

    Windows of chunk + overlap code points go to tasks one by one and are pre-tokenised and encoded there, from their
    first boundary to their last; of the text nothing else moves. Two neighbours agree from the first boundary that
    both have in their overlap, since what follows a boundary doesn't depend on what stands before it: there the ids
    of the one end and those of the other begin. Ids move packed, with the boundaries of both overlaps. A text with
    neighbours that have no boundary in common (one run longer than an overlap) is encoded whole instead."""
    ship(texts.sparkSession)
    names = [x.split()[0] for x in shape.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, doc_id, text in pdf.itertuples(index=False):
                for k, at in enumerate(range(0, len(text), chunk)):
                    window = text[at : at + chunk + overlap]
                    yield pd.DataFrame({"row": [row], "doc_id": pd.array([doc_id], "Int64"), "k": [k], "last": [at + len(window) >= len(text)], "window": [window]})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, pieces, _ = encoder(path)
        size = np.array(list(map(len, pieces)))
        kind = np.uint16 if len(pieces) <= 1 << 16 else np.uint32
        for pdf in batches:
            head, tail, packed = [], [], []
            for k, last, window in zip(pdf["k"], pdf["last"], pdf["window"]):
                at = np.array([*([0] if k == 0 else []), *boundaries(window, last)], np.int64)
                part = window[at[0] : len(window) if last else at[-1]] if len(at) else ""
                ids = np.array(encoding.encode_ordinary(part), kind)
                raw = np.frombuffer(part.encode(), np.uint8)
                starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # of code points, in bytes
                place = np.searchsorted(np.concatenate([[0], np.cumsum(size[ids])]), starts[at - at[0]]) if len(at) else at
                both = np.stack([at + k * chunk, place])
                head.append(both[:, at < overlap].tobytes())
                tail.append(both[:, at >= chunk].tobytes())
                packed.append(ids.tobytes())
            yield pdf[["row", "doc_id", "k", "last"]].assign(head=head, tail=tail, ids=packed)

    def stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, pieces, digits = encoder(path)
        kind = np.uint16 if len(pieces) <= 1 << 16 else np.uint32
        for pdf in batches:
            out = []
            for row, doc_id, parts in pdf.itertuples(index=False):
                ids, start = [], 0
                for p, after in zip(parts, [*parts[1:], None]):
                    own = np.frombuffer(p["ids"], kind)
                    stop, begin = len(own), 0
                    if after is not None:
                        a, b = (np.frombuffer(x, np.int64).reshape(2, -1) for x in (p["tail"], after["head"]))
                        _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
                        if not len(i):
                            break
                        stop, begin = a[1, i[0]], b[1, j[0]]
                    ids.append(own[start:stop])
                    start = begin
                whole = np.concatenate(ids) if len(ids) == len(parts) else None
                out.append((row, doc_id, None, *[None] * len(names)) if whole is None else (row, doc_id, len(whole), *finish(whole, pieces, digits)))
            yield pd.DataFrame(out, columns=["row", "doc_id", "n", *names]).astype({"doc_id": "Int64", "n": "Int64"})

    windows = texts.select("row", "doc_id", "text").mapInPandas(cut, "row long, doc_id long, k int, last boolean, window string").repartition("row", "k")
    parts = windows.mapInPandas(encode, "row long, doc_id long, k int, last boolean, head binary, tail binary, ids binary")
    parts = parts.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "head", "tail", "ids"))).alias("parts"))
    found = stored(parts.mapInPandas(stitch, f"row long, doc_id long, n long, {shape}"), "stitched")
    rest = texts.join(small(stored(found.where("n is null").select("row"), "unmet")), "row", "left_semi")
    return found.where("n is not null").drop("row").unionByName(encode_texts(rest, ["doc_id"], path, "text", finish, shape))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", finish: Finish = as_text, shape: str = TEXT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n and what finish makes of the ids of every row of docs.

    A null or empty text has no ids. Repeated rows are encoded each for itself, whatever their ids. Other columns are
    ignored; an empty table gives an empty result. Texts of up to chunk code points are one chunk and are never
    shuffled; longer ones spread over tasks by window, so that a very long text is no task of its own until its ids
    meet. These are stored with a row number first: a task that runs again finds the same numbers."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = encode_texts(rows.where(F.char_length("text") <= chunk), ["doc_id"], path, "text", finish, shape)
    long = stored(rows.where(F.char_length("text") > chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "long")
    return short.unionByName(encode_long_texts(long, path, finish, shape, chunk, overlap))


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs: encode_documents with digests."""
    return encode_documents(docs, path, id_col, text_col, digests, DIGESTS, chunk, overlap).withColumnRenamed("n", "n_tokens")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def decode_ids(ids: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """ids with a column decoded: the text of comma-joined ids, their bytes put together (null ids: null)."""
    ship(ids.sparkSession)

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        pieces = encoder(path)[1]
        return s.map(lambda x: None if x is None else b"".join(pieces[int(i)] for i in x.split(",") if i))

    return ids.withColumn("decoded", run(F.col(ids_col)))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), ranks_path())


def reference_digest(text: str, path: str) -> tuple[int, str, str]:
    """What op1 returns for a text, from the whole text at once."""
    ids = encoder(path)[0].encode_ordinary(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(encoder(path)[0].decode_bytes(ids)).hexdigest()
