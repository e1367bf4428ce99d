"""A Spark data source for VCF text: plain, gzipped, or in blocks (BGZF, ``.bgz`` or ``.gz``), read by byte ranges in many tasks.

A row is a variant: ``part, nth`` (the range's number and the line's place in it,
which together follow the file's order), ``chrom, pos, ref, alt`` (the first of
several ALT alleles), ``alts`` and ``calls`` (the samples' fields as they stand).
Filters on chrom, pos, ref and alt are pushed down: a line is dropped by its first
five fields, before its calls are looked at or sent.

A range of a plain file owns the lines that begin in it, but for the first, and
the one that begins right after it.  A range of a BGZF file owns its blocks' lines
in the same way: blocks are found by their headers, and the range's last line is
read on into the next block.  Other gzip files are one range, as they can't be
entered in the middle.  Paths are what ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import operator
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "part long, nth long, chrom string, pos int, ref string, alt string, alts string, calls string"
#: Bytes of a file that a task reads, and of calls that are sent at once.
SPAN, _TOGETHER = 64 << 20, 8 << 20
_MAGIC = b"\x1f\x8b\x08\x04"
_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda x, values: x in values}


@dataclass
class Range(InputPartition):
    number: int
    path: str
    kind: str
    start: int
    end: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _block(data: bytes, at: int) -> int | None:
    """The length of the BGZF block that begins here; None if none does (or not whole enough to tell)."""
    if data[at : at + 4] != _MAGIC or len(data) < at + 18:
        return None
    extra, field = struct.unpack_from("<H", data, at + 10)[0], at + 12
    while field + 4 <= min(at + 12 + extra, len(data)):
        name, size = data[field : field + 2], struct.unpack_from("<H", data, field + 2)[0]
        if name == b"BC" and size == 2 and field + 6 <= len(data):
            return struct.unpack_from("<H", data, field + 4)[0] + 1
        field += 4 + size
    return None


def _kind(start: bytes) -> str:
    return "plain" if start[:2] != _MAGIC[:2] else "gzip" if _block(start, 0) is None else "blocks"


def _blocks(file, start: int, end: int, size: int) -> Iterator[tuple[bool, bytes]]:
    """Unpacked blocks from the first one that begins in the range on, and whether each begins in the range."""
    at, data, base = start, b"", start

    def have(n: int) -> bytes:
        nonlocal data, base
        if base + len(data) < min(at + n, size):
            file.seek(base + len(data))
            data = data[at - base :] + file.read(max(n, 1 << 20))
            base = at
        return data

    while at < end:  # a header may be found by chance: the block it tells of must unpack and be followed by another
        have(1 << 17)
        length = _block(data, at - base)
        if length and (at + length == size or _block(data, at - base + length)):
            try:
                zlib.decompress(data[at - base : at - base + length], 31)
                break
            except zlib.error:
                pass
        found = data.find(_MAGIC, at - base + 1)
        at = base + found if found >= 0 else base + max(len(data) - 3, at - base + 1)
    while at < size:
        have(1 << 17)
        length = _block(data, at - base)
        if not length:
            raise ValueError(f"no block at byte {at}")
        yield at < end, zlib.decompress(data[at - base : at - base + length], 31)
        at += length


def lines(part: Range) -> Iterator[bytes]:
    """The lines that a range owns."""
    system, path = _opened(part.path)
    with system.open_input_file(path) as file:
        size = file.size()

        def pieces() -> Iterator[tuple[bool, bytes]]:
            if part.kind == "blocks":
                yield from _blocks(file, part.start, part.end, size)
            elif part.kind == "gzip":
                unpack = zlib.decompressobj(31)
                while raw := file.read(1 << 20):
                    while raw:
                        yield True, unpack.decompress(raw)
                        raw = unpack.unused_data
                        if unpack.eof and raw:
                            unpack = zlib.decompressobj(31)
            else:
                file.seek(part.start)
                at = part.start
                while at < size:
                    stop = part.end if at < part.end else size
                    raw = file.read(min(1 << 20, stop - at))
                    yield at < part.end, raw
                    at += len(raw)

        held, skip = b"", part.start > 0
        for inside, piece in pieces():
            if not inside:
                first, newline, _ = piece.partition(b"\n")
                held += first
                if not newline:
                    continue
                if not skip:
                    yield held
                return
            *whole, held = (held + piece).split(b"\n")
            if skip and whole:
                whole, skip = whole[1:], False
            yield from whole
        if held and not skip:
            yield held


class Reader(DataSourceReader):
    def __init__(self, path: str, span: int) -> None:
        self.path, self.span, self.filters = path, span, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _COMPARED and f.attribute in (("chrom",), ("pos",), ("ref",), ("alt",)):
                self.filters.append((f.attribute[0], _COMPARED[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        system, path = _opened(self.path)
        info = system.get_file_info(path)
        files = [info] if info.is_file else sorted((f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.path)
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        out = []
        for f in files:
            with system.open_input_file(f.path) as file:
                kind = _kind(file.read(1 << 16))
            step = max(1, f.size if kind == "gzip" else self.span)
            out += [Range(len(out) + n, prefix + f.path, kind, start, min(start + step, f.size)) for n, start in enumerate(range(0, f.size, step))]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for nth, line in enumerate(lines(part)):
            if line.startswith(b"#"):
                continue
            fields = line.rstrip(b"\r").split(b"\t", 9)
            if len(fields) < 10:
                continue
            chrom, place, _, ref, alts = (x.decode("utf-8", "replace") for x in fields[:5])
            pos = int(place) if re.fullmatch(r"[+-]?[0-9]{1,10}", place) and abs(int(place)) < 1 << 31 else None
            told = {"chrom": chrom, "pos": pos, "ref": ref, "alt": alts.split(",")[0]}
            if all(told[name] is not None and test(told[name], value) for name, test, value in self.filters):
                rows.append((part.number, nth, *told.values(), alts, fields[9].decode("utf-8", "replace")))
                size += len(line)
                if size > _TOGETHER:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


class VcfSource(DataSource):
    """``spark.read.format("vcf_variants").load(path)``; the option ``span`` says how many bytes a task reads."""

    @classmethod
    def name(cls) -> str:
        return "vcf_variants"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("span", SPAN)))


def variant_lines(spark: SparkSession, path: str, span: int = SPAN) -> DataFrame:
    """A file's or folder's variants.  Lets Spark push filters into Python sources (a session setting; it changes no result)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VcfSource)
    return spark.read.format("vcf_variants").option("span", span).load(path)


def sample_names(path: str, span: int = SPAN) -> list[str]:
    """The samples that the first file's header names; only its beginning is read."""
    first = Reader(path, span).partitions()[:1]
    for line in lines(first[0]) if first else ():
        if line.startswith(b"#CHROM"):
            return line.decode("utf-8", "replace").rstrip("\r").split("\t")[9:]
        if not line.startswith(b"#"):
            break
    return []
