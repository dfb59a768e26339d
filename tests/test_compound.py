"""Compound files written here, sector by sector, and read back."""

import struct
import zlib

import pytest
from threadmill.sources import compound

END, ABSENT, TABLE = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD


def record(tag, body):
    n = len(body)
    return struct.pack("<I", tag | min(n, 0xFFF) << 20) + (struct.pack("<I", n) if n >= 0xFFF else b"") + body


def compound_file(files):
    """files: (path, bytes); storages are made for folders. Streams under 4,096 bytes lie in the small stream."""
    sectors, chains = [b""], {}  # sector 0 is the table

    def put(body):
        at, n = len(sectors), -(-len(body) // 512)
        sectors.extend(body[k * 512 : (k + 1) * 512].ljust(512, b"\0") for k in range(n))
        chains.update({at + k: at + k + 1 if k < n - 1 else END for k in range(n)})
        return at if n else END

    inner, inner_table, entries = b"", [], [["Root Entry", 5, ABSENT, ABSENT, ABSENT, END, 0]]

    def add(name, kind, first, size, parent):
        entries.append([name, kind, ABSENT, ABSENT, ABSENT, first, size])
        new = len(entries) - 1
        if entries[parent][4] == ABSENT:
            entries[parent][4] = new
        else:  # chained on the left, which is a tree too
            at = entries[parent][4]
            while entries[at][2] != ABSENT:
                at = entries[at][2]
            entries[at][2] = new
        return new

    folders = {}
    for path, body in files:
        parent = 0
        for folder in path[:-1]:
            parent = folders[folder] if folder in folders else folders.setdefault(folder, add(folder, 1, 0, 0, parent))
        if len(body) >= 4096:
            first = put(body)
        else:
            n = -(-len(body) // 64)
            first = len(inner_table) if n else END
            inner_table += [len(inner_table) + k + 1 for k in range(n - 1)] + [END] * (n > 0)
            inner += body.ljust(n * 64, b"\0")
        add(path[-1], 2, first, len(body), parent)
    entries[0][5:] = [put(inner), len(inner)]
    small = put(b"".join(struct.pack("<I", k) for k in inner_table).ljust(512, b"\xff"))
    packed = b"".join((n.encode("utf-16le").ljust(64, b"\0") + struct.pack("<HBB3I", 2 * len(n) + 2, kind, 1, *tree) + bytes(36) + struct.pack("<IQ", first, size)) for n, kind, *tree, first, size in entries)
    directory = put(packed.ljust(-(-len(packed) // 512) * 512, b"\0"))
    assert len(sectors) <= 128
    sectors[0] = b"".join(struct.pack("<I", TABLE if k == 0 else chains.get(k, ABSENT)) for k in range(128))
    head = compound.MARK + bytes(16) + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<10I", 0, 1, directory, 0, 4096, small, 1, END, 0, 0) + struct.pack("<108I", *[ABSENT] * 108)
    return head + b"".join(sectors)


def document(sections, packed=True):
    flags = bytes(36) + struct.pack("<I", int(packed)) + bytes(216)
    pack = lambda b: (lambda z: z.compress(b) + z.flush())(zlib.compressobj(9, zlib.DEFLATED, -15)) if packed else b
    rest = [(("BodyText", f"Section{k}"), pack(b"".join(record(t, x) for t, x in records))) for k, records in sections]
    return compound_file([(("FileHeader",), flags), *rest, (("DocInfo",), b"not read"), (("Scripts", "Section0"), b"nor this")])


def text(x):
    return (compound.PARAGRAPH_TEXT, x.encode("utf-16le"))


@pytest.mark.parametrize("packed", [True, False])
def test_sections_in_order(packed):
    long = "영주 " * 3000  # a record of over 4,095 bytes, in the large sectors
    got = compound.document_text(document([(10, [text("last")]), (2, [text("둘째\x02\x03 「절」 汤捯")]), (0, [(66, b"\1\2\3"), text("first, "), text(long), text("end")])], packed))
    assert got == "first, " + long + "end둘째 「절」 last"
    assert compound.document_text(document([(0, [])], packed)) == ""


def test_folder_with_broken_files(spark, tmp_path):
    good = document([(0, [text("한 줄")]), (1, [text(" 두 줄" * 2000)])], False)
    for name, data in {"good.hwp": good, "cut.hwp": good[:3000], "other.hwp": b"plain text", "bare.hwp": compound_file([(("x",), b"1")]), "left.txt": good}.items():
        (tmp_path / name).write_bytes(data)
    fine, skipped = compound.read_documents(spark, str(tmp_path))
    assert [(r.name.rsplit("/", 1)[1], r.text) for r in fine.collect()] == [("good.hwp", "한 줄" + " 두 줄" * 2000)]
    assert {r.name.rsplit("/", 1)[1] for r in skipped.collect()} == {"cut.hwp", "other.hwp", "bare.hwp"} and all(r.reason for r in skipped.collect())
    none, no_reasons = compound.read_documents(spark, str(tmp_path), "*.none")
    assert none.collect() == [] and no_reasons.collect() == []
