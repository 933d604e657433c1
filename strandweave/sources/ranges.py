"""FASTA and FASTQ files by byte ranges: plain text and blocked gzip (BGZF).

A file is dealt to tasks as byte ranges.  A task takes the records whose line begins behind a
line break of its own range, and reads on behind the range to end the last one, so every
record is read once and no task holds a file, however large.  In blocked gzip a range takes the
blocks that begin in it; the first one is found by its header and that of its successor.

A place in a file is (``chunk``, ``within``): the byte where a block begins and the byte inside
its text, for plain files the byte where a chunk begins and the byte behind that.

Files are opened through Arrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import fnmatch
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

CHUNK = 1 << 20  # bytes read at once of a plain file
SPLIT = 64 << 20  # bytes of a file that a task takes
BATCH = 8 << 20  # bases handed to Spark at once
BLOCK_TEXT = 0xFF00  # bytes of text in a written block
# A BGZF block begins with these bytes, with its size at byte 16; the last block is empty.
BLOCK_MAGIC, BLOCK_FIELD = b"\x1f\x8b\x08\x04", b"BC\x02\x00"
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_SPACE = b" \t\r\n\v\f"

Chunks = Iterator[tuple[int, bytes]]
Record = tuple[int, int, int, str, str]  # chunk, within, size in bytes of text, id, bases


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    try:
        return fs.FileSystem.from_uri(path)
    except pa.ArrowInvalid as e:
        raise ValueError(f"Arrow has no file system for {path}; unpack the reads and read them as text") from e


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the visible files of a folder, or of what a pattern in the name meets."""
    store, root = filesystem(path)
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    folder, pattern = (root, "*") if info.type == fs.FileType.Directory else os.path.split(root)
    inside = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    names = [x for x in inside if x.type == fs.FileType.File and x.base_name[0] not in "._" and fnmatch.fnmatch(x.base_name, pattern)]
    if not names:
        raise FileNotFoundError(path)
    return [(prefix + x.path, x.size) for x in sorted(names, key=lambda x: x.path)]


# --------------------------------------------------------------------------- chunks


def block_size(head: bytes) -> int | None:
    """Bytes of the block that begins with these 18 bytes; None if none does."""
    if len(head) < 18 or head[:4] != BLOCK_MAGIC or head[12:16] != BLOCK_FIELD:
        return None
    return int.from_bytes(head[16:18], "little") + 1


def first_block(file, at: int, size: int) -> int | None:
    """Where the first block at or behind ``at`` begins; a block is at most 64 KiB long."""
    file.seek(at)
    window = file.read(2 * (1 << 16) + 36)
    for m in re.finditer(re.escape(BLOCK_MAGIC), window):
        n = block_size(window[m.start() : m.start() + 18])
        if n is not None:
            following = at + m.start() + n
            file.seek(following)
            if following == size or block_size(file.read(18)) is not None:
                return at + m.start()
    return None


def block_chunks(file, at: int, size: int) -> Chunks:
    """(offset, text) of the blocks from ``at`` on, which must be a block's begin or 0 or inside the file."""
    place = first_block(file, at, size)
    while place is not None and place < size:
        file.seek(place)
        head = file.read(18)
        n = block_size(head)
        if n is None:
            raise ValueError(f"no block at byte {place}")
        yield place, zlib.decompress(head + file.read(n - 18), 31)
        place += n


def plain_chunks(file, at: int, hi: int, size: int, chunk: int = CHUNK) -> Chunks:
    """(offset, text) from ``at`` on; no chunk lies on both sides of ``hi``."""
    file.seek(at)
    while at < size:
        data = file.read(min(chunk, hi - at) if at < hi else chunk)
        if not data:
            return
        yield at, data
        at += len(data)


def stream_chunks(file) -> Chunks:
    """Text of a gzip file without blocks, of any number of members, as one range."""
    unpack, at = zlib.decompressobj(31), 0
    while data := file.read(CHUNK):
        while data:
            text = unpack.decompress(data)
            if text:
                yield at, text
                at += len(text)
            data = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)


# -------------------------------------------------------------------------- records


def fasta_records(chunks: Chunks, hi: float, first: bool) -> Iterator[Record]:
    """Records whose ``>`` stands behind a line break of a chunk before ``hi``; the file begins with one."""
    carry, carried = (b"\n", True) if first else (b"", False)
    parts: list[bytes] | None = None
    place = (0, 0)

    def record():
        raw = b"".join(parts)
        head, _, body = raw.partition(b"\n")
        if names := head[1:].split():
            yield (*place, len(raw), names[0].decode(), body.translate(None, _SPACE).decode())

    for pos, data in chunks:
        inside = pos < hi
        if parts is None and not inside and not (carry and carried):
            return
        text, begin = carry + data, len(carry)
        for m in re.finditer(b"\n>", text):
            if parts is not None:
                parts.append(text[begin : m.start() + 1])
                yield from record()
                parts = None
            if not (carried if m.start() < len(carry) else inside):
                return
            parts, place, begin = [], (pos, m.end() - 1 - len(carry)), m.end() - 1
        if parts is not None:
            parts.append(text[begin:])
        if data:
            carry, carried = (b"\n", inside) if data.endswith(b"\n") else (b"", False)
    if parts is not None:
        yield from record()


def text_lines(chunks: Chunks, hi: float, first: bool) -> Iterator[tuple[bool, tuple[int, int], bytes]]:
    """(owned, place, line) of whole lines; a line is owned if the break before it stands before ``hi``."""
    known, owned, place, parts = first, first, None, []
    for pos, data in chunks:
        i = 0
        while i < len(data):
            j = data.find(b"\n", i)
            if known:
                place = place or (pos, i)
                parts.append(data[i:] if j < 0 else data[i:j])
            if j < 0:
                break
            if known:
                yield owned, place, b"".join(parts)
            known, owned, place, parts, i = True, pos < hi, None, [], j + 1
    if parts:
        yield owned, place, b"".join(parts)


def fastq_records(chunks: Chunks, hi: float, first: bool) -> Iterator[Record]:
    """Records of four lines whose first line is owned.

    A range begins anywhere; a record begins at a line with ``@`` whose second next begins with
    ``+``.  A line of qualities may begin with ``@``, but its second next holds bases.
    """
    held: list[tuple] = []

    def record():
        lines = [line.rstrip(b"\r") for _, _, line in held]
        if not any(x.strip() for x in lines):  # blank lines behind the last record
            return
        if not lines[0].startswith(b"@"):
            raise ValueError("FASTQ record without @")
        size = sum(len(line) + 1 for _, _, line in held)
        yield (*held[0][1], size, (lines[0][1:].split() or [b""])[0].decode(), (lines[1:2] or [b""])[0].strip().decode())

    met = first
    for line in text_lines(chunks, hi, first):
        held.append(line)
        if not held[0][0]:
            return
        if not met and len(held) == 3:
            if held[0][2].startswith(b"@") and held[2][2].startswith(b"+"):
                met = True
            else:
                held.pop(0)
        elif met and len(held) == 4:
            yield from record()
            held = []
    if met and held:
        yield from record()


RECORDS = {"fasta": fasta_records, "fastq": fastq_records}


# ---------------------------------------------------------------------- data source


@dataclass
class Range(InputPartition):
    """Bytes ``lo`` to ``hi`` of a file; ``form`` is plain, blocks, or stream for the whole file."""

    path: str
    kind: str
    form: str
    lo: int
    hi: int
    size: int


def form_of(path: str, size: int, packed: str | bool) -> str:
    if not packed:
        return "plain"
    store, root = filesystem(path)
    with store.open_input_file(root) as file:
        return "blocks" if block_size(file.read(18)) is not None and size else "stream"


def records_of(part: Range) -> Iterator[Record]:
    store, root = filesystem(part.path)
    with store.open_input_file(root) as file:
        if part.form == "stream":
            yield from RECORDS[part.kind](stream_chunks(file), float("inf"), True)
        else:
            chunks = block_chunks(file, part.lo, part.size) if part.form == "blocks" else plain_chunks(file, part.lo, part.hi, part.size)
            yield from RECORDS[part.kind](chunks, part.hi, part.lo == 0)


class ReadFiles(DataSource):
    """``spark.read.format("reads").load(path)``: read_id, seq and the place of every record.

    Options: ``split`` (bytes of a task), ``kind`` (fasta or fastq, for names that do not tell),
    ``bases`` = "false" to leave seq out.  Written tables
    (read_id, seq) become blocked gzip FASTA parts that ``load`` reads again.
    """

    @classmethod
    def name(cls) -> str:
        return "reads"

    def schema(self) -> str:
        seq = "" if self.options.get("bases") == "false" else ", seq string"
        return f"read_id string{seq}, path string, kind string, form string, chunk long, within long, size long"

    def reader(self, schema) -> DataSourceReader:
        return ReadFilesReader(dict(self.options), "seq" in schema.names)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BlockedFastaWriter(self.options["path"], overwrite)


class ReadFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str], bases: bool):
        self.options, self.bases = options, bases

    def partitions(self) -> list[Range]:
        from strandweave.sources.fasta import file_format

        split, parts = int(self.options.get("split", SPLIT)), []
        for path, size in list_files(self.options["path"]):
            kind, packed = (self.options["kind"], path.endswith("gz")) if "kind" in self.options else file_format(path)
            form = form_of(path, size, packed)
            step = max(size, 1) if form == "stream" else split
            parts += [Range(path, kind, form, lo, min(lo + step, size), size) for lo in range(0, size, step)]
        return parts

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[Record] = []
        bases = 0

        def batch():
            chunk, within, size, names, seqs = (list(c) for c in zip(*rows, strict=True))
            n = len(rows)
            columns = {"read_id": names, "seq": seqs, "path": [partition.path] * n, "kind": [partition.kind] * n, "form": [partition.form] * n, "chunk": chunk, "within": within, "size": size}
            return pa.RecordBatch.from_pydict({k: v for k, v in columns.items() if k != "seq" or self.bases})

        for record in records_of(partition):
            rows.append(record)
            bases += len(record[4])
            if bases >= BATCH or len(rows) >= 10_000:
                yield batch()
                rows, bases = [], 0
        if rows:
            yield batch()


# --------------------------------------------------------------------- single records


def record_at(file, kind: str, form: str, chunk: int, within: int, size: int) -> Record:
    """The record at a place; of a plain file no byte outside it is read, of blocks those that hold it."""
    if form == "blocks":
        blocks = block_chunks(file, chunk, file.size())
        at, text = next(blocks)
        parts, left = [text[within : within + size]], size - (len(text) - within)
        while left > 0:
            at, text = next(blocks)
            parts.append(text[:left])
            left -= len(text)
        raw = b"".join(parts)
    else:
        file.seek(chunk + within)
        raw = file.read(size)
    return next(RECORDS[kind](iter([(0, raw)]), 1, True))


# ------------------------------------------------------------------------------ sink


def packed_block(text: bytes) -> bytes:
    """One block of blocked gzip; ``text`` is at most ``BLOCK_TEXT`` long."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(text) + pack.flush()
    head = BLOCK_MAGIC + bytes(4) + b"\x00\xff\x06\x00" + BLOCK_FIELD + (len(body) + 25).to_bytes(2, "little")
    return head + body + zlib.crc32(text).to_bytes(4, "little") + len(text).to_bytes(4, "little")


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    final: str


class BlockedFastaWriter(DataSourceArrowWriter):
    """Each task writes a hidden file; the job's commit makes those of the tasks that count visible."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, root = filesystem(self.folder)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.fa.bgz"
        held = b""
        with store.open_output_stream(f"{root}/.{name}") as file:
            for batch in iterator:
                for read_id, seq in zip(batch.column("read_id"), batch.column("seq"), strict=True):
                    held += f">{read_id.as_py()}\n{seq.as_py() or ''}\n".encode()
                    full = len(held) // BLOCK_TEXT * BLOCK_TEXT
                    for i in range(0, full, BLOCK_TEXT):
                        file.write(packed_block(held[i : i + BLOCK_TEXT]))
                    held = held[full:]
            if held:
                file.write(packed_block(held))
            file.write(LAST_BLOCK)
        return Written(f"{root}/.{name}", f"{root}/{name}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = filesystem(self.folder)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.base_name.startswith("part-") and old.base_name.endswith(".fa.bgz"):
                    store.delete_file(old.path)
        for m in messages:
            if m is not None:
                store.move(m.hidden, m.final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = filesystem(self.folder)
        for m in messages:
            if m is not None:
                store.delete_file(m.hidden)
