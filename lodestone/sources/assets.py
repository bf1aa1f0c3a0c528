"""Image files as a data source that reads a few ranges of each: `spark.read.format("assets").load(root)`.

A file's first and last 8 KB give its content hash, its head the picture's size (of a JPEG, also the few bytes of each
segment before the frame). Partitions are folders, so the driver lists only as far down as it takes to get enough of
them; what lies below is listed and read by the tasks. Any file system that Arrow opens by URI will do.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import struct
from collections.abc import Iterator

import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.sources.files import EXTENSIONS, HEAD, SKIPPED

SCHEMA = "path string, name string, folder string, depth int, format string, size long, modified timestamp, hash string, width int, height int, error string"
PARTITIONS = 64
#: Segments of a JPEG that are looked at before its frame.
SEGMENTS = 10_000


class Ranges:
    """An open file of known size that is read by ranges. read counts the bytes."""

    def __init__(self, file, size: int):
        self.file, self.size, self.read, self.head = file, size, 0, b""
        self.head = self.at(0, min(HEAD, size))

    def at(self, begin: int, n: int) -> bytes:
        if begin + n <= len(self.head):
            return self.head[begin : begin + n]
        got = self.file.read_at(max(0, min(n, self.size - begin)), begin) if begin < self.size else b""
        self.read += len(got)
        return got

    def content_hash(self) -> str:
        """SHA-256 of the size (8 bytes, little-endian), the first 8 KB and the last 8 KB that don't overlap them."""
        h = hashlib.sha256(struct.pack("<q", self.size) + self.head)
        if self.size > HEAD:
            h.update(self.at(max(HEAD, self.size - HEAD), HEAD))
        return h.hexdigest()


def _png(f: Ranges) -> tuple[int, int]:
    if f.at(0, 8) != b"\x89PNG\r\n\x1a\n" or f.at(12, 4) != b"IHDR":
        raise ValueError("no PNG header")
    return struct.unpack(">II", f.at(16, 8))


def _psd(f: Ranges) -> tuple[int, int]:
    if f.at(0, 4) != b"8BPS" or len(f.at(0, 26)) < 26:
        raise ValueError("no PSD header")
    height, width = struct.unpack(">II", f.at(14, 8))
    return width, height


def _jpg(f: Ranges) -> tuple[int, int]:
    if f.at(0, 2) != b"\xff\xd8":
        raise ValueError("no JPEG header")
    at = 2
    for _ in range(SEGMENTS):
        mark = f.at(at, 9)
        if len(mark) < 4 or mark[0] != 0xFF:
            break
        kind = mark[1]
        if kind == 0xFF:
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and len(mark) == 9:
            height, width = struct.unpack(">HH", mark[5:9])
            return width, height
        elif kind == 0x01 or 0xD0 <= kind <= 0xD7:
            at += 2
        elif kind in (0xD9, 0xDA):
            break
        else:
            at += 2 + struct.unpack(">H", mark[2:4])[0]
    raise ValueError("no JPEG frame")


#: A format's extensions, and what reads its size; the first that takes a file's extension parses it.
PARSERS = (("PSD", ("psd",), _psd), ("PNG", ("png",), _png), ("JPG", ("jpg", "jpeg"), _jpg))


def parser_of(name: str):
    """(format, reader) for a file's name, or (None, None)."""
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    return next(((f, read) for f, exts, read in PARSERS if ext in exts), (None, None))


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class AssetReader(DataSourceReader):
    def __init__(self, root: str, partitions: int, extensions: tuple[str, ...]):
        self.root, self.n, self.extensions = root.rstrip("/") or "/", partitions, extensions

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("/") else f"file:{self.root}")

    @staticmethod
    def _hidden(name: str) -> bool:
        return name.startswith(".") or name in SKIPPED

    def partitions(self) -> list[Folder]:
        """Folders to be read with all below them, and those above, whose own files only are."""
        system, base = self._open()
        whole, level = [], [base]
        while level and len(level) + len(whole) < self.n:
            below = [f.path for p in level for f in system.get_file_info(fs.FileSelector(p)) if f.type == fs.FileType.Directory and not self._hidden(f.base_name)]
            whole += [Folder(p, False) for p in level]
            level = below
        return whole + [Folder(p, True) for p in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        system, base = self._open()
        waiting = [partition.path]
        while waiting:
            for f in system.get_file_info(fs.FileSelector(waiting.pop())):
                if f.type == fs.FileType.Directory:
                    if partition.deep and not self._hidden(f.base_name):
                        waiting.append(f.path)
                elif f.extension.lower() in self.extensions:
                    yield self._row(system, base, f)

    def _row(self, system: fs.FileSystem, base: str, f: fs.FileInfo) -> tuple:
        folder = f.path[len(base) :].strip("/").rpartition("/")[0]
        kind, read = parser_of(f.base_name)
        width = height = digest = error = None
        try:
            with system.open_input_file(f.path) as file:
                ranges = Ranges(file, f.size)
                digest = ranges.content_hash()
                if read:
                    width, height = read(ranges)
        except (OSError, ValueError, struct.error) as e:
            error = str(e)[:500]
        modified = f.mtime if f.mtime is not None else dt.datetime.fromtimestamp(0, dt.timezone.utc)
        return f.path, f.base_name, folder, folder.count("/") + 1 if folder else 0, kind or f.extension.upper(), f.size, modified, digest, width, height, error


class Assets(DataSource):
    """Options: path (a folder or its URI), partitions, extensions (with commas)."""

    @classmethod
    def name(cls) -> str:
        return "assets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AssetReader:
        given = self.options.get("extensions")
        return AssetReader(self.options["path"], int(self.options.get("partitions", PARTITIONS)), tuple(given.split(",")) if given else EXTENSIONS)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Assets)
