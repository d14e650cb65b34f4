"""Files and archives as rows: path and content of every member, unpacked to a depth."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a row can hold at most; an archive with a larger member comes as it is.
LARGEST_ROW = (1 << 31) - (1 << 20)
#: Unpacked rows are handed on in parts of about so many bytes and rows, so that a task holds few of them.
UNPACKED_BYTES, UNPACKED_ROWS = 4 << 20, 1000
_ROWS = pa.schema([("path", pa.string()), ("content", pa.binary())])

_DAMAGED = (OSError, EOFError, ValueError, tarfile.TarError, zipfile.BadZipFile, lzma.LZMAError, RuntimeError, struct.error, zstandard.ZstdError)


class TooLarge(ValueError):
    """A member that no row can hold."""


def _whole(stream) -> bytes:
    data = stream.read(LARGEST_ROW + 1)
    if len(data) > LARGEST_ROW:
        raise TooLarge
    return data


def inflated(content: bytes) -> bytes | None:
    """A compressed content unpacked, by its first bytes: gzip, bzip2, xz, lzma, zstd; None if it is none of them."""
    raw = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        return _whole(gzip.GzipFile(fileobj=raw))
    if content[:3] == b"BZh":
        return _whole(bz2.BZ2File(raw))
    if content[:6] == b"\xfd7zXZ\x00" or content[:3] == b"\x5d\x00\x00":
        return _whole(lzma.LZMAFile(raw))
    if content[:4] == b"\x28\xb5\x2f\xfd":
        return _whole(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True))
    return None


def _zip(content: bytes) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for i in z.infolist():
            if not i.is_dir():
                with z.open(i) as member:
                    yield i.filename, _whole(member)


def _tar(content: bytes) -> Iterator[tuple[str, bytes]]:
    with tarfile.open(fileobj=io.BytesIO(content)) as t:
        for m in t:
            if m.isfile():
                yield m.name, _whole(t.extractfile(m))


def _ar(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Members of an ar archive, as Debian packages are: 60-byte headers, even offsets."""
    at = 8
    while at + 60 <= len(content):
        size = int(content[at + 48 : at + 58])
        yield content[at : at + 16].decode("ascii", "replace").strip().rstrip("/"), content[at + 60 : at + 60 + size]
        at += 60 + size + size % 2


def _cpio(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Regular files of a cpio archive in the portable form: headers of hexadecimal fields, all parts at multiples of four."""
    at = 0
    while content[at : at + 6] in (b"070701", b"070702"):
        mode, size, name_size = (int(content[at + 6 + 8 * i : at + 14 + 8 * i], 16) for i in (1, 6, 11))
        start = at + 110 + name_size
        name = content[at + 110 : start - 1].decode("utf-8", "replace")
        if name == "TRAILER!!!":
            return
        start += -start % 4
        if mode >> 12 == 8:
            yield name, content[start : start + size]
        at = start + size + -size % 4


def rpm_header(content: bytes, at: int) -> tuple[dict[int, object], int]:
    """Tags of the RPM header structure at an offset, and where it ends: strings, lists of strings, numbers."""
    magic, entries, size = struct.unpack_from(">4s4xII", content, at)
    if magic != b"\x8e\xad\xe8\x01":
        raise ValueError("no header")
    store = at + 16 + 16 * entries
    text = lambda i: content[i : content.index(b"\0", i)].decode("utf-8", "replace")
    tags: dict[int, object] = {}
    for i in range(entries):
        tag, kind, offset, count = struct.unpack_from(">IIII", content, at + 16 + 16 * i)
        place = store + offset
        if kind == 6:
            tags[tag] = text(place)
        elif kind in (8, 9):
            values = []
            for _ in range(count):
                values.append(text(place))
                place += len(values[-1].encode("utf-8", "replace")) + 1
            tags[tag] = values[0] if kind == 9 and values else values
        elif kind == 4:
            tags[tag] = list(struct.unpack_from(f">{count}I", content, place))
    return tags, store + size


def rpm_parts(content: bytes) -> tuple[dict[int, object], bytes]:
    """The main header of a binary RPM package and its packed payload: a lead, a signature header, the header."""
    _, end = rpm_header(content, 96)
    tags, end = rpm_header(content, end + -end % 8)
    return tags, content[end:]


def members(content: bytes) -> Iterator[tuple[str, bytes]] | None:
    """Name and content of each member, by the first bytes of an archive, one after the other; None if it is none."""
    if content[:4] == b"PK\x03\x04":
        return _zip(content)
    if content[257:262] == b"ustar":
        return _tar(content)
    if content[:8] == b"!<arch>\n":
        return _ar(content)
    if content[:6] in (b"070701", b"070702"):
        return _cpio(content)
    if content[:4] == b"\xed\xab\xee\xdb":
        return _cpio(inflated(rpm_parts(content)[1]) or b"")
    data = inflated(content)
    return None if data is None else iter([("", data)])


def unpacked(files: DataFrame, depth: int = 5) -> DataFrame:
    """path, content of all files in files(path, content), archives replaced by their members.

    gzip, bzip2, xz, lzma, zstd, zip, tar, ar, cpio and RPM. A compressed file's member takes its name without the last
    extension. Archives that hold what no row can hold (2 GiB), and those nested deeper, come as they are; of a
    damaged one the members before the damage are there, then it comes as it is. One archive is one task's work, member
    by member; many archives spread. Null contents stay null.
    """

    def walk(path: str, content: bytes, left: int) -> Iterator[tuple[str, bytes]]:
        try:
            inside = members(content) if left and content else None
            if inside is None:
                yield path, content
                return
            for name, data in inside:
                yield from walk(f"{path}/{name}" if name else path.rpartition(".")[0] or path, data, left - 1)
        except _DAMAGED:
            yield path, content

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, contents, size = [], [], 0
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):  # Python has one row at a time
                for name, data in walk(path.as_py(), content.as_py(), depth):
                    paths.append(name)
                    contents.append(data)
                    size += len(data or b"")
                    if size > UNPACKED_BYTES or len(paths) >= UNPACKED_ROWS:
                        yield pa.record_batch([paths, contents], schema=_ROWS)
                        paths, contents, size = [], [], 0
        if paths:
            yield pa.record_batch([paths, contents], schema=_ROWS)

    return files.select("path", "content").mapInArrow(unpack, "path string, content binary")


# Numbers of the tags of an RPM header.
RPM_TAGS = {"package": 1000, "version": 1001, "release": 1002, "summary": 1004, "vendor": 1011, "license": 1014, "packager": 1015, "group": 1016, "url": 1020, "architecture": 1022, "source_package": 1044, "requires": 1049}


def rpm_packages(files: DataFrame) -> DataFrame:
    """pfile_fk with the fields of the headers of files(pfile_fk, content) that are RPM packages (I8); others and damaged ones have no row."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for pfile, content in zip(rows.pfile_fk, rows.content, strict=True):
                try:
                    tags, _ = rpm_parts(content)
                except _DAMAGED:
                    continue
                out.append((pfile, *[tags.get(n, [] if c == "requires" else None) for c, n in RPM_TAGS.items()]))
            yield pd.DataFrame(out, columns=["pfile_fk", *RPM_TAGS])

    worth = files.filter(F.hex(F.substring("content", 1, 4)) == "EDABEEDB").select(F.col("pfile_fk").cast("long"), "content")
    return worth.mapInPandas(read, "pfile_fk long, " + ", ".join(f"{c} {'array<string>' if c == 'requires' else 'string'}" for c in RPM_TAGS))


def read_files(spark: SparkSession, path: str, pattern: str = "*", unpack: bool = True) -> DataFrame:
    """path and content of the files of a folder and its subfolders, with archives unpacked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")
    return unpacked(files) if unpack else files


def decoded(files: DataFrame) -> DataFrame:
    """files with text (I10); JVM only.

    The charset is guessed from the first bytes: byte-order marks of UTF-32 and UTF-16, every other byte zero for
    UTF-16 without one; else UTF-8 if the whole content is valid, else Latin-1.
    """
    content, head = F.col("content"), F.hex(F.substring("content", 1, 32))
    latin = F.decode(content, "ISO-8859-1")
    wide = F.when(head.rlike("^(FFFE0000|0000FEFF)"), F.decode(content, "UTF-32"))
    wide = wide.when(head.startswith("FFFE"), F.decode(content, "UTF-16LE")).when(head.startswith("FEFF"), F.decode(content, "UTF-16BE"))
    wide = wide.when(head.rlike("^([0-9A-F]{2}00){4,}$") & ~head.startswith("00"), F.decode(content, "UTF-16LE")).when(head.rlike("^(00[0-9A-F]{2}){4,}$") & ~head.rlike("^0000"), F.decode(content, "UTF-16BE"))
    text = F.coalesce(wide, F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")), latin)
    return files.withColumn("text", F.regexp_replace(text, "^\ufeff", ""))
