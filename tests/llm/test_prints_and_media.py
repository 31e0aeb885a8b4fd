import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

from colloquy.llm import merkle, mpeg


def chain(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(order):
        a, b = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(a) // 3
        e = a[: len(a) - n] + b[:n]
        out.append((doc, len(a), hashlib.sha256(e.encode()).hexdigest(), merkle.fingerprint(a.encode()), merkle.fingerprint(e.encode())))
    return sorted(out, key=repr)


def test_neighbours(spark):
    rows = [(i, f"Text {i}. More of it é.\n\nPart {i * i} of {i}.\n" * (i % 5)) for i in range(40)] + [(7, "a tie"), (3, None), (None, "nameless"), (None, "nameless too")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, range int")
    got = merkle.neighbour_prints(docs).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == chain(rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_few_documents(spark):
    schema = "doc_id long, text string"
    assert merkle.neighbour_prints(spark.createDataFrame([], schema)).collect() == []
    for rows in ([(1, "alone and by itself")], [(None, "no name")], [(None, "no name"), (None, None), (2, "")]):
        got = merkle.neighbour_prints(spark.createDataFrame(rows, schema)).collect()
        assert sorted((tuple(r)[:5] for r in got), key=repr) == chain(rows)


def test_trees():
    a = "One. Two. Three.\nFour!\n\n\nFive? Six.\n" * 5
    b = a.replace("Five", "Fife", 1)
    x, y = merkle.fingerprint(a.encode()), merkle.fingerprint(b.encode())
    assert x == merkle.fingerprint(a.encode()) and x != y
    assert 0.9 < merkle.likeness(merkle.branches(x), merkle.branches(y)) < 1
    assert merkle.likeness(merkle.branches(x), merkle.branches(merkle.fingerprint(b"zzz"))) == 0
    assert [(s, n) for s, _, n in merkle.edits(x, y)] == [("a", 6), ("b", 6)]
    at = merkle.edits(x, y)[0][1]
    assert a[at : at + 5] == "Five?"
    assert merkle.likeness(merkle.branches(merkle.fingerprint(b"")), merkle.branches(merkle.fingerprint(b""))) == 1
    for line in (b"", b"no end", b"x" * 1000, b"a. b. c.", b"... . ?", "é. ü".encode() * 90):
        assert b"".join(merkle.leaves(line)) == line


def tree(text):
    """Digests of every node from the definition, and the bytes that two trees share, by plain recursion."""
    name = lambda kind, parts: hashlib.blake2b(b"".join(parts), digest_size=16, person=kind).digest()
    sections, held = [[]], []
    for line in text.split(b"\n"):
        if line and sections[-1] and not sections[-1][-1]:
            sections.append([])
        sections[-1].append(line)
    for lines in sections:
        nodes = [(name(b"paragraph", [name(b"leaf", [x]) for x in merkle.leaves(line)]), merkle.leaves(line)) for line in lines]
        held.append((name(b"section", [n for n, _ in nodes]), nodes))
    return name(b"root", [n for n, _ in held]), held


def test_roots_and_likeness_against_the_definition():
    texts = ["", "\n", "One. Two.\nThree.\n\n\nFour? " + "long " * 90, "One. Two.\nThree!\n\n\nFour? " + "long " * 90, "Three.\nOne. Two.\n\nX", "é. ü!\n\nOne. Two."]
    for a in texts:
        root, sections = tree(a.encode())
        shown = merkle.fingerprint(a.encode())
        assert shown.split("/")[0] == root.hex() and [s.split("+")[0] for s in shown.split("/")[1:]] == [n.hex()[:16] for n, _ in sections]
        for b in texts:
            other, theirs = tree(b.encode())
            x, y = (Counter(leaf for _, lines in t for _, parts in lines for leaf in parts) for t in (sections, theirs))
            whole = sum(map(len, x.elements())) + sum(map(len, y.elements()))
            # whatever branches share, their leaves share
            likeness = merkle.likeness(merkle.branches(shown), merkle.branches(merkle.fingerprint(b.encode())))
            assert (root == other) == (a == b) and likeness <= 1
            if a != b:
                assert abs(likeness - (2 * sum(map(len, (x & y).elements())) / whole if whole else 1)) < 1e-9


def frame(header, fill=0x55, crc=True):
    shape = mpeg.header(header)
    body = bytes([fill]) * (shape.length - 4)
    if shape.protected:
        side = body[2 : 2 + shape.side]
        body = mpeg.crc16(header[2:] + side).to_bytes(2, "big") + body[2:]
    return header + body


def test_round_trip():
    for text in (b"", b"x", b"y" * 192, "é".encode() * 500):
        payload = mpeg.padded(text)
        assert len(payload) % 192 == 0 and payload.startswith(text) and len(payload) >= 192
        data = mpeg.write(payload)
        stream = mpeg.read(data)
        assert mpeg.carried(data, stream) == payload
        assert stream.skipped == 0 and not stream.damaged and stream.checked == len(payload) // 192
        assert stream.duration == Fraction(len(payload) // 192 * 1152, 48000)
        assert stream.table["kind"] == "Info" and stream.table["frames"] == len(stream.frames)
        assert stream.tags["TXXX:payload crc32"] == f"{zlib.crc32(payload):08x}"
        assert stream.seek(0) == stream.frames[0][0] and stream.seek(stream.duration) is None


def test_damage_resync_and_tables():
    one = bytes((0xFF, 0xFB, 0x90, 0x00))  # 128 kbit/s, 44.1 kHz
    two = bytes((0xFF, 0xFB, 0xB0, 0x00))  # 192 kbit/s
    good = [frame(one), frame(two), frame(one)]
    stream = mpeg.read(b"junk\xff\xfbjunk" + b"".join(good) + b"\xff" * 7 + b"".join(good) + b"TAG" + b"title".ljust(125, b"\0"))
    assert [h.kbps for _, h in stream.frames] == [128, 192, 128, 128, 192, 128]
    assert stream.skipped == 10 + 7 and stream.tags["TIT2"] == "title"
    assert stream.duration == Fraction(6 * 1152, 44100)
    bad = bytearray(mpeg.write(mpeg.padded(b"z" * 600)))
    third = mpeg.read(bytes(bad)).frames[2][0]
    bad[third + 8] ^= 1
    assert mpeg.read(bytes(bad)).damaged == [third]
    vbri = bytearray(frame(one, 0))
    vbri[36:40], vbri[46:62] = b"VBRI", bytes.fromhex("00001000" + "00000003" + "0002" + "0001" + "0002" + "0002")
    vbri[62:66] = bytes.fromhex("01000200")
    table = mpeg.read(bytes(vbri) + b"".join(good)).table
    assert table["frames"] == 3 and table["toc"] == [0, 256, 768]
    assert mpeg.read(b"").frames == [] and mpeg.read(b"\xff" * 50).frames == []


def bitwise_crc(bits):
    value = 0xFFFF
    for bit in bits:
        value = (value << 1) ^ (0x8005 if (value >> 15 & 1) != bit else 0)
        value &= 0xFFFF
    return value


def test_checksums_of_the_other_layers():
    draw = random.Random(4)
    # header bytes 2 to 4, bits of allocation, subbands that are shared by both channels
    kinds = [(0xFE, 0x44, 0x00, [4] * 64, 0), (0xFE, 0x44, 0xC0, [4] * 32, 0), (0xFE, 0x44, 0x50, [4] * (16 + 24), 24), (0xFC, 0xC0, 0x00, [n for n in [4] * 11 + [3] * 12 + [2] * 7 for _ in (0, 1)], 0), (0xFC, 0x14, 0xC0, [4] * 2 + [3] * 6, 0), (0xFC, 0x18, 0xC0, [4] * 2 + [3] * 10, 0), (0xF4, 0x80, 0xC0, [4] * 4 + [3] * 7 + [2] * 19, 0)]
    for one, two, three, sizes, shared in kinds:
        head = bytes((0xFF, one, two, three))
        shape = mpeg.header(head)
        body = bytearray(draw.randbytes(shape.length - 6))
        bits = [b >> (7 - k) & 1 for b in head[2:] + bytes(body) for k in range(8)]
        at, extra = 16, 0
        for i, n in enumerate(sizes):
            extra += any(bits[at : at + n]) * (2 if shared and i >= len(sizes) - shared else 1)
            at += n
        end = at + (2 * extra if shape.layer == 2 else 0)
        frame = head + bitwise_crc(bits[:end]).to_bytes(2, "big") + bytes(body)
        good = mpeg.read(frame * 3)
        assert len(good.frames) == good.checked == 3 and not good.damaged
        for bit, hurt in ((16, True), (end - 1, True), (end, False)):
            broken = bytearray(frame)
            broken[6 + (bit - 16) // 8] ^= 0x80 >> (bit % 8)
            assert mpeg.read(frame + bytes(broken) + frame).damaged == ([len(frame)] if hurt else []), (shape, bit)


def test_columns(spark):
    docs = spark.createDataFrame([(1, "one", 5), (2, None, 5), (None, "one", 5), (3, "long " * 900, 5)], "doc_id long, text string, media int")
    rows = mpeg.media_digests(mpeg.to_media(docs)).collect()
    by = {r["doc_id"]: r for r in rows}
    for doc, text in ((1, b"one"), (2, b""), (3, b"long " * 900)):
        payload = mpeg.padded(text)
        assert by[doc]["n_bytes"] == len(text) and by[doc]["payload_bytes"] == len(payload)
        assert by[doc]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and by[doc]["tail_crc32"] == zlib.crc32(payload[-16:])
    assert by[1]["media_sha256"] == by[None]["media_sha256"] and by[1]["feature"] == by[None]["feature"]
    assert by[1]["seek_offsets"][0] == by[1]["media_bytes"] - 240 * len(by[1]["seek_offsets"]) and by[3]["samples"] == 24 * 1152 and by[3]["duration_s"] == 24 * 1152 / 48000
    assert mpeg.media_digests(mpeg.to_media(docs.limit(0))).collect() == []
    probed = mpeg.probe(mpeg.to_media(docs), keep=("doc_id",)).collect()
    assert {r["doc_id"]: len(r["seek_offsets"]) for r in probed}[3] == 24
    nothing = mpeg.probe(spark.createDataFrame([(None,), (b"abc",)], "media binary")).collect()
    assert [r["samples"] for r in nothing] == [0, 0]
