"""BAM files as a Spark data source whose partitions are ranges of blocks."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from strandloom.sources import bgzf
from strandloom.sources.blockfiles import BlockWriter
from strandloom.sources.fasta import range_rows
from strandloom.sources.ranges import RANGE, Range, located, ranges

SCHEMA = "name string, flag int, ref string, pos long, mapq int, cigar string, mate_ref string, mate_pos long, tlen long, seq string, qual string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
# Fixed values of the format.
OPS, NIBBLES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
MAGIC = b"BAM\1"
FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mate_ref", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])
SIGNS = np.frombuffer(NIBBLES.encode(), np.uint8)
HEX_OF = str.maketrans(NIBBLES, "0123456789abcdef")
LESS_33 = bytes((b - 33) % 256 for b in range(256))
#: Records in a row by which a place is told to begin one; longest record; contents decoded at once.
LOOK, LONGEST, CONTENTS = 5, 1 << 28, 8 << 20


class Header:
    """Names of the references, and the place where the records begin."""

    def __init__(self, blocks: bgzf.Blocks) -> None:
        held, origin = b"", []
        stream = blocks.from_(0)

        def need(n: int) -> None:
            nonlocal held
            while len(held) < n:
                offset, data = next(stream, (None, b""))
                if offset is None:
                    raise bgzf.Broken(0, "header cut short")
                origin.append((len(held), offset))
                held += data

        def number(at: int) -> int:
            need(at + 4)
            return struct.unpack_from("<i", held, at)[0]

        need(4)
        if held[:4] != MAGIC:
            raise bgzf.Broken(0, "not a BAM file")
        at = 8 + number(4)
        self.refs: list[str] = []
        n = number(at)
        at += 4
        for _ in range(n):
            size = number(at)
            need(at + 8 + size)
            self.refs.append(held[at + 4 : at + 3 + size].decode())
            at += 8 + size
        begin, block = max(((b, o) for b, o in origin if b <= at), default=(0, 0))
        self.place = (block, at - begin)
        if at == len(held):  # the records begin in the next block
            offset, _ = next(stream, (blocks.size, b""))
            self.place = (offset, 0)


def plausible(data: np.ndarray, refs: int) -> np.ndarray:
    """Whether a record may begin at each byte, by its fixed fields."""
    n = len(data) - 35
    if n <= 0:
        return np.zeros(0, bool)
    byte = data.astype(np.int64)
    word = byte[:-3] | byte[1:-2] << 8 | byte[2:-1] << 16 | byte[3:] << 24
    signed = np.where(word >> 31, word - (1 << 32), word)
    at = lambda k: signed[k : k + n]
    l_name, n_cigar, l_seq = byte[12 : 12 + n], byte[16 : 16 + n] | byte[17 : 17 + n] << 8, at(20)
    ok = (at(0) >= 32) & (at(0) <= LONGEST) & (l_name > 0) & (l_seq >= 0)
    for ref, pos in ((4, 8), (24, 28)):
        ok &= (at(ref) >= -1) & (at(ref) < refs) & (at(pos) >= -1)
    return ok & (32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq <= at(0))


def first_record(contents: Iterator[bytes], refs: int) -> int | None:
    """Bytes of ``contents`` before a record: LOOK plausible ones follow each other from there, or all to the end."""
    held, want, ended = b"", 1 << 17, False
    while True:
        while len(held) < want and not ended:
            more = next(contents, None)
            ended = more is None
            held += more or b""
        ok = plausible(np.frombuffer(held, np.uint8), refs)
        unsure = False
        for c in np.flatnonzero(ok).tolist():
            at, seen = c, 0
            while seen < LOOK and at < len(ok) and ok[at]:
                l_name = held[at + 12]
                name = held[at + 36 : at + 36 + l_name]
                if len(name) == l_name and not re.fullmatch(rb"[!-~]*\x00", name):
                    break
                at, seen = at + 4 + struct.unpack_from("<i", held, at)[0], seen + 1
            if seen == LOOK or (ended and seen and at == len(held)):
                return c
            if seen and at >= len(ok) and not ended:
                unsure = True  # more contents tell
                break
        if ended:
            return None
        want = 2 * len(held) if unsure or not ok.any() else len(held) + (1 << 17)


def strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.StringArray:
    """The strings of ``data`` that begin at ``starts``."""
    stops = np.concatenate(([0], np.cumsum(lengths)))
    flat = data[np.repeat(starts - stops[:-1], lengths) + np.arange(stops[-1])]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(flat.astype(np.uint8)))


class Decoder:
    """Contents of records to batches of SCHEMA."""

    def __init__(self, refs: list[str]) -> None:
        self.refs = pa.array(refs, pa.string())
        self.cigars: dict[bytes, str] = {}

    def cigar(self, data: bytes) -> str:
        if data not in self.cigars:
            if len(self.cigars) > 100_000:
                self.cigars.clear()
            self.cigars[data] = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack(f"<{len(data) // 4}I", data))
        return self.cigars[data]

    def names(self, ref: np.ndarray) -> pa.Array:
        return self.refs.take(pa.array(np.maximum(ref, 0), pa.int32(), mask=ref < 0)) if len(self.refs) else pa.nulls(len(ref), pa.string())

    def batch(self, held: bytes, offsets: np.ndarray) -> pa.RecordBatch:
        """The records of ``held`` that begin at ``offsets``."""
        data = np.frombuffer(held + bytes([ord("*") - 33]), np.uint8)  # the last byte is the quality that isn't there
        f = np.ascontiguousarray(data[offsets[:, None] + np.arange(36)]).view(FIXED).ravel()
        l_name, l_cigar, l_seq = f["l_name"].astype(np.int64), 4 * f["n_cigar"].astype(np.int64), f["l_seq"].astype(np.int64)
        name = offsets + 36
        cigar = name + l_name
        seq = cigar + l_cigar
        qual = seq + (l_seq + 1) // 2
        absent = l_seq == 0
        absent |= data[np.minimum(qual, len(data) - 1)] == 0xFF
        stops = np.cumsum(l_seq)
        at = np.arange(stops[-1]) - np.repeat(stops - l_seq, l_seq)
        pair = data[np.repeat(seq, l_seq) + at // 2]
        bases = SIGNS[np.where(at % 2, pair & 15, pair >> 4)]
        cut = zip(cigar.tolist(), seq.tolist(), strict=True)
        columns = [
            strings(data, name, l_name - 1), pa.array(f["flag"].astype(np.int32)), self.names(f["ref"]), pa.array(f["pos"].astype(np.int64)), pa.array(f["mapq"].astype(np.int32)),
            pa.array([self.cigar(held[a:b]) for a, b in cut], pa.string()), self.names(f["mate_ref"]), pa.array(f["mate_pos"].astype(np.int64)), pa.array(f["tlen"].astype(np.int64)),
            strings(bases, stops - l_seq, l_seq), strings(data + np.uint8(33), np.where(absent, len(data) - 1, qual), np.where(absent, 1, l_seq)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=NAMES)


def walked(held: bytes, refs: int, end: bool) -> tuple[list[int], int, str | None]:
    """(offsets of the whole records, where they end, what is wrong there)."""
    offsets, at, n = [], 0, len(held)
    while at + 36 <= n:
        size, ref, pos, l_name, _, _, n_cigar, _, l_seq, mate_ref, _, _ = struct.unpack_from("<iiiBBHHHiiii", held, at)
        if size < 32 or l_seq < 0 or not l_name or not (-1 <= ref < refs and -1 <= mate_ref < refs) or 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq > size:
            return offsets, at, "not a record"
        if at + 4 + size > n:
            break
        offsets.append(at)
        at += 4 + size
    return offsets, at, "record cut short" if end and at < n else None


def decoded(blocks: bgzf.Blocks, refs: list[str], a: tuple[int, int], b: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The records from place ``a`` to ``b``; raises Broken at the block where one isn't whole."""
    decoder = Decoder(refs)
    held: list[bytes] = []
    origin: list[tuple[int, int]] = []
    size = 0

    def flush(end: bool) -> pa.RecordBatch | None:
        nonlocal held, origin, size
        data = b"".join(held)
        offsets, at, wrong = walked(data, len(refs), end)
        if wrong:
            raise bgzf.Broken(max((o for begin, o in origin if begin <= at), default=a[0]), wrong)
        origin = [(begin - at, o) for begin, o in origin]
        held, size = [data[at:]], len(data) - at
        return decoder.batch(data, np.array(offsets, np.int64)) if offsets else None

    if a < b:
        for offset, data in blocks.from_(a[0]):
            if (offset, 0) >= b:
                break
            part = data[a[1] if offset == a[0] else 0 : b[1] if offset == b[0] else None]
            origin = [*origin[-4096:], (size, offset)]
            held.append(part)
            size += len(part)
            if size >= CONTENTS and (batch := flush(False)):
                yield batch
        if batch := flush(True):
            yield batch


def place(blocks: bgzf.Blocks, header: Header, at: int) -> tuple[int, int]:
    """Where the first record after the first block at ``at`` begins, but not before the header's end."""
    if blocks.first(at) <= header.place[0]:
        return header.place
    return bgzf.place(blocks, at, lambda contents: first_record(contents, len(header.refs)))


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.length = options["path"], int(options.get("rangeBytes", RANGE))

    def partitions(self) -> list[Range]:
        return [r for r in ranges(self.path, self.length) if r.path.endswith(".bam") or r.path.endswith(self.path)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, inner = located(partition.path)
        with store.open_input_file(inner) as f:
            blocks = bgzf.Blocks(f, partition.size)
            if partition.stop == partition.size and not blocks.is_end():
                raise bgzf.Broken(partition.size, "no end-of-file marker")
            header = Header(blocks)
            yield from decoded(blocks, header.refs, *(place(blocks, header, x) for x in (partition.start, partition.stop)))


def range_faults(r: Range) -> Iterator[tuple[str, int, str]]:
    """(file, offset of a block, what is wrong there) of a range.

    After a fault, reading goes on with the first record after the next whole block. What
    is wrong with the file's header or end is told by its first or last range.
    """
    store, inner = located(r.path)
    with store.open_input_file(inner) as f:
        blocks = bgzf.Blocks(f, r.size)
        if r.stop == r.size and not blocks.is_end():
            yield r.path, r.size, "no end-of-file marker"
        try:
            header = Header(blocks)
        except bgzf.Broken as e:
            if r.start == 0:
                yield r.path, e.at, e.why
            return
        at = r.start
        while at < r.stop or at == r.start:
            try:
                a = place(blocks, header, at)
                if at > r.start and a[0] >= r.stop:
                    return
                try:
                    b = place(blocks, header, r.stop)
                except bgzf.Broken:
                    b = (blocks.first(r.stop), 0)
                for _ in decoded(blocks, header.refs, a, b):
                    pass
                return
            except bgzf.Broken as e:
                if r.start <= e.at < r.stop:
                    yield r.path, e.at, e.why
                at = max(at, e.at) + 1


def faults(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """file, at, fault of the file or the folder's files: broken blocks and records, header and end; none if all is well."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            rows = [x for r in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in range_faults(Range(*r))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "at", "fault"])

    return range_rows(spark, path, range_bytes).mapInArrow(run, "file string, at long, fault string").distinct()


def bin_of(begin: int, end: int) -> int:
    """The deepest index bin that holds the interval whole."""
    last = max(begin, end - 1)
    for shift in (14, 17, 20, 23, 26):
        if begin >> shift == last >> shift:
            return ((1 << (29 - shift)) - 1) // 7 + (begin >> shift)
    return 0


class Encoder:
    """Rows of SCHEMA as BAM records."""

    def __init__(self, contigs: list[str]) -> None:
        self.number = {n: i for i, n in enumerate(contigs)}
        self.cigars: dict[str, tuple[bytes, int, int]] = {"": (b"", 0, 1)}

    def cigar(self, text: str) -> tuple[bytes, int, int]:
        """Packed runs, their number, and the bases of the reference that they cover."""
        if text not in self.cigars:
            if len(self.cigars) > 100_000:
                self.cigars = {"": (b"", 0, 1)}
            runs = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", text)]
            packed = struct.pack(f"<{len(runs)}I", *((n << 4) + OPS.index(op) for n, op in runs))
            self.cigars[text] = packed, len(runs), sum(n for n, op in runs if op in "MDN=X") or 1
        return self.cigars[text]

    def records(self, batch: pa.RecordBatch) -> Iterator[bytes]:
        number = self.number.get
        for name, flag, ref, pos, mapq, cigar, mate_ref, mate_pos, tlen, seq, qual in zip(*(batch.column(n).to_pylist() for n in NAMES), strict=True):
            runs, n, span = self.cigar(cigar or "")
            mate = ref if mate_ref == "=" else mate_ref
            quals = b"\xff" * len(seq) if qual == "*" and len(seq) != 1 else qual.encode().translate(LESS_33)
            tail = name.encode() + b"\0" + runs + bytes.fromhex(seq.translate(HEX_OF) + "0" * (len(seq) % 2)) + (quals if seq else b"")
            yield struct.pack("<iiiBBHHHiiii", 32 + len(tail), number(ref, -1), pos, len(name) + 1, mapq, bin_of(pos, pos + span), n, flag, len(seq), number(mate, -1), -1 if mate_pos is None else mate_pos, tlen) + tail


class BamSource(DataSource):
    """``format("bam")``; option ``rangeBytes`` is the length of a range.

    The writer takes option ``contigs`` as name:length, comma-separated, and ``single``
    for one file at the path in place of a folder of files.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> BlockWriter:
        header = [(n, int(size)) for n, size in (c.rsplit(":", 1) for c in self.options["contigs"].split(",") if c)]
        text = "@HD\tVN:1.5\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in header) + "@RG\tID:1\tSM:1\n"
        head = MAGIC + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(header))
        head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in header)
        return BlockWriter(self.options["path"], "bam", head, Encoder([n for n, _ in header]).records, self.options.get("single", "false") == "true")


def read(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("rangeBytes", range_bytes).load(path)


def write(reads: DataFrame, path: str, contigs: list[tuple[str, int]], single: bool = False) -> None:
    """Write ``reads`` (SCHEMA) in coordinate order, unmapped ones last; each file is a range of it, or all is one."""
    spark = reads.sparkSession
    spark.dataSource.register(BamSource)
    order = {n: i for i, (n, _) in enumerate(contigs)}
    number = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    ordered = reads.withColumn("contig_no", F.coalesce(F.try_element_at(number, F.col("ref")), F.lit(len(order)))).orderBy("contig_no", "pos", "name")
    out = ordered.select(NAMES).write.format("bam").option("contigs", ",".join(f"{n}:{size}" for n, size in contigs)).option("single", str(single).lower())
    out.mode("append").save(path)


def fault(path: str) -> str | None:
    """The first thing that is wrong with a file, else null."""
    return next((why for r in ranges(path, RANGE) for _, _, why in range_faults(r)), None)
