"""Archives by parts: zip, tar, ISO 9660 images and cabinets that these tests write themselves or the standard library does."""

import io
import random
import struct
import tarfile
import zipfile
import zlib

from pyspark.sql import functions as F

from ledgerline.sources import archive_parts as A

rnd = random.Random(2)
FILES = {f"d{i % 3}/f{i}.txt": bytes(rnd.choice(b"abc \n") for _ in range(rnd.choice([0, 1, 100, 3000, 70_000]))) for i in range(12)}


def zipped(files, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("empty/", b"")
        for name, data in files.items():
            z.writestr(name, data)
        z.comment = b"no PK in here"
    return out.getvalue()


def tarred(files, form):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=form) as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "d0/f0.txt"
        t.addfile(link)
    return out.getvalue()


def image(folders):
    """An ISO 9660 image of {folder: {name: data}}, one level below the root."""
    block, blocks = 2048, [b""] * 20
    both = lambda n: struct.pack("<I", n) + struct.pack(">I", n)

    def put(data):
        blocks.append(data)
        at = len(blocks) - 1
        blocks.extend([b""] * (max(1, -(-len(data) // block)) - 1))
        return at

    def record(name, at, size, flags):
        body = b"\0" + both(at) + both(size) + bytes(7) + bytes([flags, 0, 0]) + struct.pack("<HHB", 1, 256, len(name)) + name
        body += b"\0" * (len(body) % 2 == 0)
        return bytes([len(body) + 1]) + body

    def directory(entries):
        out = b""
        for r in [record(b"\0", 0, 0, 2), record(b"\1", 0, 0, 2), *entries]:
            if len(out) % block + len(r) > block:
                out += b"\0" * (-len(out) % block)
            out += r
        return out + b"\0" * (-len(out) % block)

    top = []
    for folder, files in folders.items():
        own = [record(n.encode() + b";1", put(d), len(d), 0) for n, d in files.items()]
        data = directory(own)
        top += [record(folder.encode(), put(data), len(data), 2)] if folder else own
    root = directory(top)
    at = put(root)
    volume = bytearray(b"\1CD001\1" + bytes(2041))
    volume[128:132] = struct.pack("<H", block) + struct.pack(">H", block)
    volume[156:190] = record(b"\0", at, len(root), 2)
    blocks[16] = bytes(volume)
    out = bytearray(len(blocks) * block + block * 40)
    for i, data in enumerate(blocks):
        out[i * block : i * block + len(data)] = data or b""
    return bytes(out)


def cabinet(folders, method=1):
    """A cabinet of folders {name: data}, in blocks of 32 KiB, each packed with the one before as its dictionary."""
    data, heads, files = [], [], []
    for i, own in enumerate(folders):
        whole, offset, blocks = b"".join(own.values()), 0, []
        for name, d in own.items():
            files.append(struct.pack("<IIHHHH", len(d), offset, i, 0, 0, 0x20) + name.replace("/", "\\").encode() + b"\0")
            offset += len(d)
        for a in range(0, len(whole), 32768):
            raw = whole[a : a + 32768]
            c = zlib.compressobj(9, zlib.DEFLATED, -15, zdict=whole[a - 32768 : a]) if a else zlib.compressobj(9, zlib.DEFLATED, -15)
            packed = b"CK" + c.compress(raw) + c.flush() if method == 1 else raw
            blocks.append(struct.pack("<IHH", 0, len(packed), len(raw)) + packed)
        heads.append((len(blocks), b"".join(blocks)))
    at_files = 36 + 8 * len(folders)
    at = at_files + sum(map(len, files))
    rows = b""
    for n, body in heads:
        rows += struct.pack("<IHH", at, n, method)
        at += len(body)
        data.append(body)
    head = b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, at, 0, at_files, 0, 3, 1, len(folders), len(files), 0, 0, 0)
    return head + rows + b"".join(files) + b"".join(data)


def opened(spark, **archives):
    rows = spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in archives.items()], "path string, content binary")
    return {r.path: (bytes(r.content) if r.content is not None else None, r.whole) for r in A.unpacked_by_parts(rows, 3).collect()}


def test_members_of_every_kind(spark):
    long = {"x" * 150 + "/" + "y" * 90: b"long", "é.txt": b"accent"}
    names = {"F1.TXT": FILES["d0/f0.txt"], "F2": b"two", "BIG": bytes(5000)}
    many = {f"N{i:03}": str(i).encode() for i in range(120)}  # more records than a sector holds
    halves = [dict(list(FILES.items())[:6]), dict(list(FILES.items())[6:])]
    got = opened(
        spark, deflated=zipped(FILES), stored=zipped(FILES, zipfile.ZIP_STORED), bzip=zipped(FILES, zipfile.ZIP_BZIP2), lzma=zipped(FILES, zipfile.ZIP_LZMA), gnu=tarred(FILES | long, tarfile.GNU_FORMAT), pax=tarred(FILES | long, tarfile.PAX_FORMAT),
        iso=image({"DIR": names, "MANY": many, "": {"TOP": b"top"}}), cab=cabinet(halves), raw=cabinet(halves, 0), text=b"plain", empty=b"", none=None,
    )
    want = {f"{kind}/{n}": (d, True) for kind in ("deflated", "stored", "bzip", "lzma", "gnu", "pax", "cab", "raw") for n, d in FILES.items()}
    want |= {f"{kind}/{n}": (d, True) for kind in ("gnu", "pax") for n, d in long.items()}
    want |= {f"iso/DIR/{n}": (d, True) for n, d in names.items()} | {f"iso/MANY/{n}": (d, True) for n, d in many.items()} | {"iso/TOP": (b"top", True)}
    assert got == want | {"text": (b"plain", True), "empty": (b"", True), "none": (None, True)}


def test_damaged_archives_and_unknown_methods(spark):
    whole = zipped({"a": b"x" * 1000, "b": b"y" * 1000})
    broken = whole.replace(b"x" * 3, b"zzz")
    cut = whole[: len(whole) // 2]
    other = bytearray(zipped({"a": b"abc"}, zipfile.ZIP_STORED))
    at = other.rindex(b"PK\x01\x02")
    other[at + 10 : at + 12] = struct.pack("<H", 97)
    bad = bytearray(cabinet([{"a": b"x" * 50}]))
    bad[bad.index(b"CK")] = 0
    got = opened(spark, cut=cut, other=bytes(other), tar=tarred({"a": b"1"}, tarfile.USTAR_FORMAT)[:200] + b"9" * 400, bad=bytes(bad), same=broken)
    assert got["cut"] == (cut, True) and got["other/a"] == (b"abc", False) and got["tar"][1] and not got["bad/folder 0"][1]
    assert {n for n in got if n.startswith("same")} == {"same/a", "same/b"}


def test_one_archive_is_many_tasks(spark):
    """A zip of 10,000 members is unpacked in several partitions."""
    content = zipped({f"m{i}": str(i).encode() * 3 for i in range(10_000)})
    out = A.unpacked_by_parts(spark.createDataFrame([("big.zip", bytearray(content))], "path string, content binary"), 4)
    rows = out.select("path", "content", F.spark_partition_id().alias("part")).collect()
    assert {r.path: bytes(r.content) for r in rows} == {f"big.zip/m{i}": str(i).encode() * 3 for i in range(10_000)}
    assert len({r.part for r in rows}) == 4
