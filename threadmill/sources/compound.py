"""Word-processor documents in compound files (HWP 5.0), read by Spark as binary files and decoded in tasks."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .readers import try_items

# Fixed values of the formats: a compound file's mark, the end of a sector chain, an absent entry, the record of a
# paragraph's text, and the characters that a text keeps.
MARK = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
END, ABSENT = 0xFFFFFFFE, 0xFFFFFFFF
PARAGRAPH_TEXT = 67
KEPT = "가-힣 -~·‘-”・「」ㆍ"


def _chain(table: np.ndarray, first: int) -> list[int]:
    """The sectors of a chain, in order."""
    out, at = [], first
    while at != END:
        if at >= len(table) or len(out) > len(table):
            raise ValueError("broken sector chain")
        out.append(at)
        at = int(table[at])
    return out


def streams(data: bytes) -> dict[tuple[str, ...], bytes]:
    """The streams of a compound file by their path, in the order of the directory: shorter names first, then by name."""
    if data[:8] != MARK:
        raise ValueError("no compound file")
    size, small = (1 << s for s in struct.unpack_from("<2H", data, 30))
    first_dir, _, cutoff, first_small, _, more = struct.unpack_from("<6I", data, 48)

    def joined(chain: list[int]) -> bytes:
        parts = [data[(k + 1) * size : (k + 2) * size] for k in chain]
        if any(not p for p in parts):
            raise ValueError("sector outside the file")
        return b"".join(parts)

    listed = list(struct.unpack_from("<109I", data, 76))
    for _ in range(len(data) // size):
        if more in (END, ABSENT):
            break
        *own, more = np.frombuffer(joined([more]), "<u4").tolist()
        listed += own
    table = np.frombuffer(joined([k for k in listed if k != ABSENT]), "<u4")
    small_table = np.frombuffer(joined(_chain(table, first_small)), "<u4") if first_small != END else np.array([], "<u4")
    entries = joined(_chain(table, first_dir))

    def entry(k: int):
        """name, kind (1 storage, 2 stream, 5 root), left, right, child, first sector, size."""
        at = k * 128
        length = struct.unpack_from("<H", entries, at + 64)[0]
        return (entries[at : at + max(0, length - 2)].decode("utf-16le"), entries[at + 66], *struct.unpack_from("<3I", entries, at + 68), *struct.unpack_from("<2I", entries, at + 116))

    root = entry(0)
    inner = joined(_chain(table, root[5])) if root[5] != END else b""
    found, todo, seen = {}, [((), root[4])], set()
    while todo:
        folder, k = todo.pop()
        if k == ABSENT or k in seen:
            continue
        seen.add(k)
        name, kind, left, right, child, first, length = entry(k)
        todo += [(folder, left), (folder, right), ((*folder, name), child)]
        if kind == 2:
            if not length:
                body = b""
            elif length < cutoff:
                body = b"".join(inner[j * small : (j + 1) * small] for j in _chain(small_table, first))
            else:
                body = joined(_chain(table, first))
            if len(body) < length:
                raise ValueError("stream cut short")
            found[(*folder, name)] = body[:length]
    return dict(sorted(found.items(), key=lambda x: [(len(n), n.upper()) for n in x[0]]))


def paragraph_texts(section: bytes) -> list[str]:
    """The paragraph texts of a section's records. A header has the tag in 10 bits and the length in its upper 12; where
    these are all ones, the next four bytes have the length."""
    out, at = [], 0
    while at + 4 <= len(section):
        head = struct.unpack_from("<I", section, at)[0]
        tag, length, at = head & 0x3FF, head >> 20, at + 4
        if length == 0xFFF and at + 4 <= len(section):
            length, at = struct.unpack_from("<I", section, at)[0], at + 4
        if tag == PARAGRAPH_TEXT:
            out.append(section[at : at + length].decode("utf-16le", "ignore"))
        at += length
    return out


def document_text(data: bytes) -> str:
    """The text of a document: its sections' paragraphs, without what isn't kept, blanks collapsed."""
    parts = streams(data)
    packed = bool(parts[("FileHeader",)][36] & 1)
    out = []
    for path, body in parts.items():
        if path[0] == "BodyText":
            out += paragraph_texts(zlib.decompress(body, -15) if packed else body)
    return re.sub(" {2,}", " ", re.sub(f"[^{KEPT}]", " ", "".join(out))).strip()


def read_documents(spark: SparkSession, path: str, pattern: str = "*.hwp") -> tuple[DataFrame, DataFrame]:
    """(name, text) of the documents of a folder, and (name, reason) of the files that can't be decoded: broken, cut
    short, of another format or without a header. An empty document has an empty text. A file is a row, and its decoding
    a task's; name is its path. Spark's reader passes over files without a byte."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return try_items(files.selectExpr("path AS name", "content"), document_text)
