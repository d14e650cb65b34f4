"""Archives whose members are unpacked by many tasks: a directory is read once, members are dealt out packed.

What an archive holds and where (the central directory of a zip, the headers of a tar, the directory records of an
ISO 9660 image, the folders of a cabinet) is read without unpacking anything. Each member, or folder of a cabinet whose
files are packed together, then is a row of packed bytes, which a shuffle spreads over tasks to be unpacked.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Packed bytes of members that a task hands on at once.
BATCH_BYTES = 32 << 20
#: Directories within directories of an image.
MOST_DEPTH = 64
_DAMAGED = (struct.error, ValueError, IndexError, zlib.error, EOFError, OSError, lzma.LZMAError)
#: How a part is packed. Cabinet folders are unpacked whole and cut into their files.
STORED, DEFLATED, BZIP2, LZMA, CABINET, OTHER = "stored", "deflated", "bzip2", "lzma", "cabinet", "other"

# Numbers of compression methods of a zip.
_ZIP_METHODS = {0: STORED, 8: DEFLATED, 12: BZIP2, 14: LZMA}

Part = tuple[str, str, bytes, list[tuple[str, int, int]]]  # member, how, packed bytes, files (name, offset, size) of a folder


def zip_parts(content: bytes) -> Iterator[Part]:
    """Members of a zip by its central directory; sizes beyond 32 bits come from the extra field."""
    end = content.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of the central directory")
    count, size, at = struct.unpack_from("<HII", content, end + 10)
    if 0xFFFF in (count,) or 0xFFFFFFFF in (size, at):
        wide = content.rfind(b"PK\x06\x06", 0, end)
        count, _, size, at = struct.unpack_from("<QQQQ", content, wide + 24)
        count = struct.unpack_from("<Q", content, wide + 32)[0]
        at = struct.unpack_from("<Q", content, wide + 48)[0]
    for _ in range(count):
        if content[at : at + 4] != b"PK\x01\x02":
            raise ValueError("no member where one is listed")
        flags, method = struct.unpack_from("<HH", content, at + 8)
        packed, full = struct.unpack_from("<II", content, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", content, at + 28)
        start = struct.unpack_from("<I", content, at + 42)[0]
        raw = content[at + 46 : at + 46 + n_name]
        extra = content[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                start = next(values) if start == 0xFFFFFFFF else start
            extra = extra[4 + n :]
        name = raw.decode("utf-8" if flags & 0x800 else "cp437", "replace")
        at += 46 + n_name + n_extra + n_comment
        if not name.endswith("/"):
            own_name, own_extra = struct.unpack_from("<HH", content, start + 26)
            begin = start + 30 + own_name + own_extra
            yield name, OTHER if flags & 1 else _ZIP_METHODS.get(method, OTHER), content[begin : begin + packed], []


def tar_parts(content: bytes) -> Iterator[Part]:
    """Regular files of a tar by its headers, with long names of either kind."""
    at, long_name = 0, None
    number = lambda field: int.from_bytes(field[1:], "big") if field[:1] == b"\x80" else int(field.rstrip(b" \0") or b"0", 8)
    while len(block := content[at : at + 512]) == 512 and block.strip(b"\0"):
        if sum(block[:148]) + 256 + sum(block[156:]) != number(block[148:156]):
            raise ValueError("a header's sum is wrong")
        size, kind = number(block[124:136]), block[156:157]
        body = content[at + 512 : at + 512 + size]
        at += 512 + (size + 511) // 512 * 512
        if kind == b"L":
            long_name = body.rstrip(b"\0").decode("utf-8", "replace")
        elif kind == b"x":
            rest = body
            while rest:
                n = int(rest.split(b" ", 1)[0])
                key, _, value = rest[:n].split(b" ", 1)[1][:-1].partition(b"=")
                long_name = value.decode("utf-8", "replace") if key == b"path" else long_name
                rest = rest[n:]
        else:
            name, prefix = (block[a:b].split(b"\0", 1)[0].decode("utf-8", "replace") for a, b in ((0, 100), (345, 500)))
            full = long_name or (f"{prefix}/{name}" if prefix and block[257:262] == b"ustar" else name)
            if kind in (b"0", b"\0", b"7"):
                yield full, STORED, body, []
            long_name = None


def iso_parts(content: bytes) -> Iterator[Part]:
    """Files of an ISO 9660 image by the directory records below its root; of versions the number is cut off."""
    block = struct.unpack_from("<H", content, 16 * 2048 + 128)[0]
    rest = [("", struct.unpack_from("<II", content[16 * 2048 + 156 :], 2)[0], struct.unpack_from("<I", content, 16 * 2048 + 166)[0], 0)]
    while rest:
        folder, extent, size, depth = rest.pop()
        if depth > MOST_DEPTH:
            raise ValueError("directories hold each other")
        at, end = extent * block, extent * block + size
        while at < end:
            length = content[at]
            if not length:  # records do not cross sectors
                at = (at // 2048 + 1) * 2048
                continue
            own, own_size, flags = struct.unpack_from("<I", content, at + 2)[0], struct.unpack_from("<I", content, at + 10)[0], content[at + 25]
            raw = content[at + 33 : at + 33 + content[at + 32]]
            at += length
            if raw in (b"\0", b"\1"):  # itself and the one above
                continue
            name = folder + raw.decode("ascii", "replace").split(";")[0].rstrip(".")
            if flags & 2:
                rest.append((f"{name}/", own, own_size, depth + 1))
            else:
                yield name, STORED, content[own * block : own * block + own_size], []


def cab_parts(content: bytes) -> Iterator[Part]:
    """Folders of a cabinet with the files in each; a folder's blocks are packed one on the other, so it is one part."""
    first_file, n_folders, n_files, flags = struct.unpack_from("<I", content, 16)[0], *struct.unpack_from("<HHH", content, 26)
    at, own_folder, own_data = 36, 0, 0
    if flags & 4:
        header, own_folder, own_data = struct.unpack_from("<HBB", content, at)
        at += 4 + header
    for flag in (1, 2):  # names of the cabinets before and after
        for _ in range(2 * bool(flags & flag)):
            at = content.index(b"\0", at) + 1
    files: dict[int, list[tuple[str, int, int]]] = {}
    place = first_file
    for _ in range(n_files):
        size, offset, folder = struct.unpack_from("<IIH", content, place)
        attributes = struct.unpack_from("<H", content, place + 14)[0]
        end = content.index(b"\0", place + 16)
        name = content[place + 16 : end].decode("utf-8" if attributes & 0x80 else "cp1252", "replace").replace("\\", "/")
        files.setdefault(folder, []).append((name, offset, size))
        place = end + 1
    for i in range(n_folders):
        start, blocks, method = struct.unpack_from("<IHH", content, at)
        at += 8 + own_folder
        body = [struct.pack("<H", method & 15)]
        for _ in range(blocks):
            packed, full = struct.unpack_from("<HH", content, start + 4)
            begin = start + 8 + own_data
            body += [struct.pack("<HH", packed, full), content[begin : begin + packed]]
            start = begin + packed
        yield f"folder {i}", CABINET if method & 15 in (0, 1) else OTHER, b"".join(body), files.get(i, [])


def parts(content: bytes) -> Iterator[Part] | None:
    """Parts of an archive by its first bytes (zip, tar, ISO 9660, cabinet); None of what is none of them."""
    if content[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return zip_parts(content)
    if content[257:262] == b"ustar":
        return tar_parts(content)
    if content[16 * 2048 + 1 : 16 * 2048 + 6] == b"CD001":
        return iso_parts(content)
    if content[:4] == b"MSCF":
        return cab_parts(content)
    return None


def _folder(data: bytes) -> bytes:
    """The files of a cabinet's folder, unpacked; each block may refer to the one before."""
    method, at, out = struct.unpack_from("<H", data)[0], 2, []
    while at < len(data):
        packed, full = struct.unpack_from("<HH", data, at)
        block = data[at + 4 : at + 4 + packed]
        at += 4 + packed
        if method == 1:
            if block[:2] != b"CK":
                raise ValueError("no packed block")
            state = zlib.decompressobj(-15, zdict=out[-1]) if out else zlib.decompressobj(-15)
            block = state.decompress(block[2:]) + state.flush()
        if len(block) != full:
            raise ValueError("a block of another size")
        out.append(block)
    return b"".join(out)


def unpacked_part(how: str, data: bytes) -> bytes:
    if how == DEFLATED:
        return zlib.decompressobj(-15).decompress(data)
    if how == BZIP2:
        return bz2.decompress(data)
    if how == LZMA:
        size = struct.unpack_from("<H", data, 2)[0]
        filters = [lzma._decode_filter_properties(lzma.FILTER_LZMA1, data[4 : 4 + size])]
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(data[4 + size :])
    return _folder(data) if how == CABINET else data


_FILES = pa.list_(pa.struct([("name", pa.string()), ("offset", pa.int64()), ("size", pa.int64())]))
_PART = "path string, member string, how string, data binary, files array<struct<name:string,offset:long,size:long>>"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            body = content.as_py()
            try:
                found = list(parts(body or b"") or ())
            except _DAMAGED:
                found = []
            yield from ((path, *x) for x in found)
            if not found:
                yield path, None, STORED, body, []

    for batch in batches:
        held, size = [], 0
        for row in rows(batch):
            held.append((*row[:4], [{"name": n, "offset": o, "size": s} for n, o, s in row[4]]))
            size += len(row[3] or b"")
            if size >= BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), _FILES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "member", "how", "data", "files"])


def listed_parts(files: DataFrame) -> DataFrame:
    """path, member, how, data (packed), files of files(path, content): one row a member, nothing unpacked.

    What is no archive, is damaged or empty is one row of a null member. A row holds up to 2 GiB, so an archive
    and a member are no larger than that.
    """
    return files.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(_listed, _PART)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for path, member, how, data, files in zip(*[batch.column(i) for i in range(5)], strict=True):
            name, kind, body = f"{path}/{member}" if member.is_valid else path.as_py(), how.as_py(), data.as_py()
            try:
                whole = unpacked_part(kind, body) if kind not in (STORED, OTHER) else body
            except _DAMAGED:
                out.append((name, body, False))
                continue
            if kind == CABINET:
                out += [(f"{path}/{f['name']}", whole[f["offset"] : f["offset"] + f["size"]], True) for f in files.as_py()]
            else:
                out.append((name, whole, kind != OTHER))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string(), pa.binary(), pa.bool_()], strict=True)], ["path", "content", "whole"])


def unpacked_by_parts(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """path, content and whole of all members of files(path, content), one level deep.

    Members of one archive are unpacked by as many tasks as there are partitions. Those packed in a way that is not
    known, with a password, or damaged come packed, with whole false; other files come as they are.
    """
    listed = listed_parts(files)
    dealt = listed.repartition(partitions, "path", "member") if partitions else listed.repartition("path", "member")
    return dealt.mapInArrow(_opened, "path string, content binary, whole boolean")
