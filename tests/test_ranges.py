"""Files by byte ranges: FASTQ, FASTA by index, BAM by blocks, and the writers in blocks."""

import gzip
import random
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandloom.operators.chunks import piece_trinucleotides, recut, trinucleotide_counts
from strandloom.plans import learners, validate
from strandloom.sources import bam, bgzf, fasta, fastq
from strandloom.sources.ranges import Range, located, ranges

# FASTQ


def fastq_text(n=40, seed=1):
    """Records whose qualities often begin with the signs of headers and separators; some reads are empty."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        size = rnd.choice([0, 1, 2, 7, 30, 200])
        qual = "".join(rnd.choice("@+IJ!>") for _ in range(size))
        if size and i % 2:
            qual = "@" + qual[1:]
        out.append((f"@r{i}/1", "".join(rnd.choice("ACGTN") for _ in range(size)), "+" if i % 3 else f"+r{i}/1", qual))
    return out


def records_of(path, length):
    """name, seq, plus, qual over all ranges of a file, read one by one."""
    reader = fastq.FastqReader({"path": str(path), "rangeBytes": str(length)})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["offset"] for r in rows] == sorted({r["offset"] for r in rows})
    return [tuple(r[c] for c in ("name", "seq", "plus", "qual")) for r in rows]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_cut_at_every_byte(tmp_path, end):
    want = fastq_text()
    path = tmp_path / "x.fq"
    path.write_bytes("".join(end.join(r) + end for r in want).encode())
    size = path.stat().st_size
    reader = fastq.FastqReader({"path": str(path)})
    for cut in range(1, size):
        got = [r for a, b in ((0, cut), (cut, size)) for x in reader.read(Range(str(path), a, b, size)) for r in x.to_pylist()]
        assert [tuple(r[c] for c in ("name", "seq", "plus", "qual")) for r in got] == want
    for length in (1, 3, 50, 997):
        assert records_of(path, length) == want


def test_fastq_offsets_and_ends(tmp_path):
    path = tmp_path / "x.fq"
    path.write_text("@a\nAC\n+\nII\n@b\nA\n+\n@\n\n\n")
    reader = fastq.FastqReader({"path": str(path)})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["name"], r["offset"]) for r in rows] == [("@a", 0), ("@b", 11)]
    path.write_text("@a\nAC\n+\nII\n@b\nA\n+")
    assert records_of(path, 1000) == [("@a", "AC", "+", "II"), ("@b", "A", "+", None)]
    path.write_text("")
    assert records_of(path, 1000) == []


def test_fastq_faults_are_kept(tmp_path):
    """Records with faults belong to one range, whatever the cut."""
    rows = fastq_text(60, 2)
    for i in (3, 17, 18, 44):
        rows[i] = (rows[i][0].lstrip("@"), rows[i][1] + "A", rows[i][2], rows[i][3])
    path = tmp_path / "x.fq"
    path.write_text("".join("\n".join(r) + "\n" for r in rows))
    for length in (40, 111, 300):
        assert records_of(path, length) == rows


@pytest.mark.parametrize("kind", ["plain", "gzip", "blocks"])
def test_fastq_source(spark, tmp_path, kind):
    rows = fastq_text(3000, 3)
    text = "".join("\n".join(r) + "\n" for r in rows).encode()
    if kind == "plain":
        (tmp_path / "x.fq").write_bytes(text)
    elif kind == "gzip":
        (tmp_path / "x.fq.gz").write_bytes(gzip.compress(text))
    else:
        (tmp_path / "x.fq.gz").write_bytes(b"".join(bgzf.compressed(text[i : i + 3001]) for i in range(0, len(text), 3001)) + bgzf.END)
    df = fastq.read(spark, str(tmp_path), 10_000)
    assert df.rdd.getNumPartitions() > 5 or kind == "gzip"
    got = df.orderBy("offset").select("name", "seq", "plus", "qual").collect()
    assert sorted(map(tuple, got)) == sorted(rows)
    if kind != "blocks":
        assert list(map(tuple, got)) == rows


def test_fastq_validation_by_ranges(spark, tmp_path):
    (tmp_path / "x.fq").write_text("@a/1\nACGT\n+\nIIII\n@b/1\nACXT\n+\n@III\n@c/1\nAC\n+\n")
    assert dict(validate.tally(fastq.read(spark, str(tmp_path), 5)).collect()) == {"ok": 1, "bad_base": 1, "missing_line": 1}


# FASTA


def fasta_text(width=11, end="\n"):
    rnd = random.Random(6)
    seqs = {f"c{i}": "".join(rnd.choice("ACGTNacgt") for _ in range(n)) for i, n in enumerate([0, 1, 10, 11, 12, 22, 500, 3, 1000])}
    text = "".join(f">{n} and more|x{end}" + "".join(s[i : i + width] + end for i in range(0, len(s), width)) for n, s in seqs.items())
    return seqs, text


@pytest.mark.parametrize("end, last", [("\n", True), ("\r\n", True), ("\n", False)])
def test_index_from_ranges_of_any_length(spark, tmp_path, end, last):
    seqs, text = fasta_text(end=end)
    text += "" if last else ">z\nAC\nG"
    seqs = seqs if last else seqs | {"z": "ACG"}
    (tmp_path / "x.fa").write_bytes(text.encode())
    want = []
    for n, s in seqs.items():
        head = f">{n} and more|x{end}" if n != "z" else ">z\n"
        at = text.index(head) + len(head)
        first = text[at:].split("\n")[0].rstrip("\r") if s else ""
        want.append((n, len(s), at, len(first), len(first) + len(end if n != "z" else "\n") if s else 0, True))
    for length in (64, 200, 1 << 20):
        got = fasta.index(spark, str(tmp_path / "x.fa"), range_bytes=length).select("chrom", "length", "offset", "line_bases", "line_width", "uniform").collect()
        assert sorted(map(tuple, got)) == sorted(want), length


def test_runs_of_every_range(tmp_path):
    """Every byte of a file is counted once, wherever it is cut."""
    seqs, text = fasta_text()
    path = tmp_path / "x.fa"
    path.write_text(text)
    store, inner = located(str(path))
    with store.open_input_file(inner) as f:
        for cut in range(1, len(text)):
            rows = [r for a, b in ((0, cut), (cut, len(text))) for r in fasta.runs(f, a, b, len(text))]
            assert sum(r[6] for r in rows) == sum(map(len, seqs.values()))
            assert [r[2].split()[0] for r in rows if r[1] is not None] == list(seqs)


def test_pieces_equal_the_sequences(spark, tmp_path):
    seqs, text = fasta_text()
    (tmp_path / "x.fa").write_text(text)
    contigs = fasta.index(spark, str(tmp_path / "x.fa"))
    got = fasta.pieces(contigs, 100, 7).collect()
    assert max(len(r.piece) for r in got) <= 107
    assert sorted((r.chrom, r.start, r.piece) for r in got) == sorted((n, i, s[i : i + 107].upper()) for n, s in seqs.items() for i in range(0, len(s), 100))
    regions = spark.createDataFrame([("c6", 5, 130), ("c6", 490, 9000), ("c3", -4, 2), ("no", 1, 2)], "chrom string, start long, end long")
    assert sorted((r.chrom, r.start, r.piece) for r in fasta.pieces(contigs, 64, 0, regions).collect()) == sorted(
        [("c6", 5, seqs["c6"][5:69].upper()), ("c6", 69, seqs["c6"][69:130].upper()), ("c6", 490, seqs["c6"][490:].upper()), ("c3", 0, seqs["c3"][:2].upper())]
    )
    whole = spark.createDataFrame([(n, s.upper()) for n, s in seqs.items()], "chrom string, seq string")
    assert sorted(map(tuple, piece_trinucleotides(fasta.pieces(contigs, 100, 2), True).collect())) == sorted(r for r in map(tuple, trinucleotide_counts(whole, True).collect()) if len(seqs[r[0]]))
    small = recut(fasta.pieces(contigs, 100), 25).collect()
    assert sorted((r.chrom, r.start, r.piece) for r in small) == sorted((n, i, s[i : i + 25].upper()) for n, s in seqs.items() for i in range(0, len(s), 25))


def test_lines_of_different_length_are_told(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a\nACGT\nACG\nACGT\n>b\nACGT\nAC\n\n>c\nAC\nACGT\n")
    contigs = fasta.index(spark, str(tmp_path / "x.fa"))
    assert dict(contigs.select("chrom", "uniform").collect()) == {"a": False, "b": True, "c": False}
    with pytest.raises(Exception, match="different length"):
        fasta.pieces(contigs.where(F.col("chrom") == "a"), 10).collect()


# BAM


def alignments(n, seed=4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        size = rnd.choice([0, 1, 5, 36, 151])
        qual = "*" if size != 1 and i % 7 == 0 else "".join(chr(rnd.randint(33, 74)) for _ in range(size)) or "*"
        rows.append((f"read{i}", rnd.choice([99, 147, 4]), rnd.choice(["c", "d", None]), rnd.randint(-1, 900), 60, rnd.choice(["", f"{size}M" if size else "", "3M1I2D4S"]), rnd.choice(["d", None]), rnd.randint(-1, 900), rnd.randint(-300, 300), "".join(rnd.choice("ACGTN=") for _ in range(size)), qual))
    return rows


CONTIGS = [("c", 1000), ("d", 2000)]


def written(tmp_path, rows, block=700):
    """A BAM file with small blocks, so that records lie across them."""
    import pyarrow as pa

    source = bam.BamSource({"path": "x", "contigs": ",".join(f"{n}:{s}" for n, s in CONTIGS)})
    writer = source.writer(None, False)
    batch = pa.RecordBatch.from_pylist([dict(zip(bam.NAMES, r, strict=True)) for r in rows], pa.schema([(n, pa.string() if n in ("name", "ref", "cigar", "mate_ref", "seq", "qual") else pa.int64()) for n in bam.NAMES]))
    data = writer.head + b"".join(writer.content(batch))
    path = tmp_path / "x.bam"
    path.write_bytes(b"".join(bgzf.compressed(data[i : i + block]) for i in range(0, len(data), block)) + bgzf.END)
    return path


def bam_rows(path, cuts):
    reader, size = bam.BamReader({"path": str(path)}), path.stat().st_size
    edges = [0, *cuts, size]
    return [tuple(r.values()) for a, b in zip(edges[:-1], edges[1:], strict=True) for x in reader.read(Range(str(path), a, b, size)) for r in x.to_pylist()]


def test_bam_cut_anywhere(tmp_path):
    rows = alignments(400)
    path = written(tmp_path, rows)
    size = path.stat().st_size
    assert bam_rows(path, []) == rows
    for cut in [*range(1, size, 211), size - 1]:
        assert bam_rows(path, [cut]) == rows, cut
    assert bam_rows(path, list(range(100, size, 100))) == rows


def test_bam_with_long_records(tmp_path):
    """Records of many blocks, and ranges in which none begins."""
    rnd = random.Random(1)
    rows = [(f"r{i}", 0, "c", i, 1, "", None, -1, 0, "".join(rnd.choice("ACGT") for _ in range(9001)), "".join(chr(rnd.randint(33, 70)) for _ in range(9001))) for i in range(30)]
    path = written(tmp_path, rows)
    assert bam_rows(path, list(range(5000, path.stat().st_size, 5000))) == rows


def test_bam_faults_by_block(spark, tmp_path):
    path = written(tmp_path, alignments(400))
    assert bam.fault(str(path)) is None and bam.faults(spark, str(path), 3000).count() == 0
    whole = path.read_bytes()
    starts, at = [], 0
    while at < len(whole):
        starts.append(at)
        at += bgzf.length_of(whole, at)
    broken = bytearray(whole)
    for i in (5, 30):
        broken[starts[i] + 40] ^= 0xFF
    path.write_bytes(broken[: -len(bgzf.END)])
    got = bam.faults(spark, str(path), 3000).collect()
    assert sorted(r["at"] for r in got) == [starts[5], starts[30], len(whole) - len(bgzf.END)]
    assert next(r.fault for r in got if r["at"] == len(whole) - len(bgzf.END)) == "no end-of-file marker"
    with pytest.raises(bgzf.Broken):
        bam_rows(path, [])
    path.write_bytes(bgzf.compressed(b"BAX\1" + bytes(40)) + bgzf.END)
    assert [r.fault for r in bam.faults(spark, str(path)).collect()] == ["not a BAM file"]


def test_bam_records_that_are_cut(tmp_path):
    rows = alignments(20)
    path = written(tmp_path, rows, 1 << 15)
    data = gzip.decompress(path.read_bytes())
    path.write_bytes(bgzf.compressed(data[:-3]) + bgzf.END)
    assert "cut short" in bam.fault(str(path))
    wrong = bytearray(data)
    at = bam.Header(bgzf.Blocks(located(str(path))[0].open_input_file(str(path)), path.stat().st_size)).place[1]
    struct.pack_into("<i", wrong, at, 7)
    path.write_bytes(bgzf.compressed(bytes(wrong)) + bgzf.END)
    assert bam.fault(str(path)) == "not a record"


@pytest.mark.parametrize("single", [False, True])
def test_bam_written_and_read_by_ranges(spark, tmp_path, single):
    rows = [r for r in alignments(3000) if r[2]]
    df = spark.createDataFrame(rows, bam.SCHEMA).repartition(5)
    path = tmp_path / ("one.bam" if single else "many")
    bam.write(df, str(path), CONTIGS, single)
    back = bam.read(spark, str(path), 20_000)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert not list(tmp_path.rglob("_temporary"))
    paths = [path] if single else sorted(path.iterdir())
    order = [(r[2], r[3]) for p in paths for r in bam_rows(p, [])]
    assert order == sorted(order) and all(bam.fault(str(p)) is None for p in paths)


def test_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.range(100, numPartitions=4).select(F.concat(F.lit("r"), "id").alias("name"), F.lit("ACG").alias("seq"), F.when(F.col("id") == 99, F.raise_error(F.lit("broken row"))).otherwise("III").cast("string").alias("qual"))
    with pytest.raises(Exception, match="broken row"):
        fastq.write(df, str(tmp_path / "out"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


@pytest.mark.parametrize("single", [False, True])
def test_fastq_in_blocks(spark, tmp_path, single):
    df = spark.range(20_000, numPartitions=6).select(F.concat(F.lit("@r"), "id", F.lit("/1")).alias("name"), F.lit("ACGT").alias("seq"), F.lit("@+II").alias("qual"))
    path = str(tmp_path / ("x.fq.gz" if single else "out"))
    fastq.write(df, path, single)
    back = fastq.read(spark, path, 5000)
    assert back.rdd.getNumPartitions() > 6
    assert sorted(map(tuple, back.select("name", "seq", "qual").collect())) == sorted(map(tuple, df.collect()))
    if single:
        assert gzip.decompress(Path(path).read_bytes()).decode().splitlines()[::4] == [f"@r{i}/1" for i in range(20_000)]
    assert ranges(path, 5000)


def test_cache_follows_the_content(spark, tmp_path):
    from strandloom.sources import sinks

    (tmp_path / "x.fa").write_text(">a\nAC\n")
    made = []
    table = lambda: made.append(1) or spark.range(len(made))
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path / "cache"), table, str(tmp_path / "x.fa")).count() == 1
    (tmp_path / "x.fa").write_text(">a\nACGT\n")
    assert sinks.cached(spark, str(tmp_path / "cache"), table, str(tmp_path / "x.fa")).count() == 2 and len(made) == 2


def test_first_sample_and_missing_genotypes(spark, tmp_path):
    from strandloom.operators import variants as vs
    from strandloom.sources import text

    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tZ\tA\n"
    (tmp_path / "x.vcf").write_text(head + "".join(f"c\t{i + 1}\t.\tA\tG\t.\tPASS\t.\t{f}\t{s}\t1/1\n" for i, (f, s) in enumerate([("GT:DP", "0|1:3"), ("DP", "4"), ("GT", "./."), ("GT", ".")])))
    got = [r.gt for r in vs.called_genotype(text.vcf(spark, str(tmp_path / "x.vcf"))).orderBy("pos").collect()]
    assert got[0] == "0|1" and all(g in ("0/1", "1/0") for g in got[1:])
    (tmp_path / "y.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc\t1\t.\tA\tG\t.\tPASS\tGT=1/1\nc\t2\t.\tA\tG\t.\tPASS\tWP=0/1;GT=1/1\n")
    assert [r.gt for r in vs.called_genotype(text.vcf(spark, str(tmp_path / "y.vcf"))).orderBy("pos").collect()] == ["1/1", "0/1"]


class Counted:
    """A file that counts the bytes that are read."""

    def __init__(self, text):
        self.text, self.n = text, 0

    def read_at(self, n, at):
        self.n += len(self.text[at : at + n])
        return self.text[at : at + n]


def test_headers_are_found_in_what_was_read():
    """Bytes read for an index are those of the range, whatever the number of contigs; a longer last line is told."""
    text = b"".join(b">c%d\nACGTACGT\nACG\n" % i for i in range(2000))
    f = Counted(text)
    rows = list(fasta.runs(f, 0, len(text), len(text)))
    assert len(rows) == 2000 and all(r[4:7] == (8, 9, 11) for r in rows)
    assert f.n < 2 * len(text)
    for cut in range(0, 60):
        both = [*fasta.runs(f, 0, cut, len(text)), *fasta.runs(f, cut, len(text), len(text))] if cut else rows
        assert [r[2:6] for r in both if r[1] is not None] == [r[2:6] for r in rows] and sum(r[6] for r in both) == 22_000


def test_windows_find_stretches_by_their_start(spark):
    """Depth of windows equals base by base sums, also of stretches that begin ahead of the sequence or end beyond it; one join."""
    seq = "".join(random.Random(3).choice("ACGT") for _ in range(1030))
    depth = [("c", random.Random(i).randrange(-80, 1000), 1 + i % 5, i) for i in range(40)] + [("c", -10, 2, 1040), ("c", 5, 9, 0), ("c", -60, 7, -3)]
    rows = [(c, s, s + n if i < 40 else n, d) for i, (c, s, d, n) in enumerate(depth)]
    df = spark.createDataFrame([*rows, ("c", 0, 100_000, 1)], "chrom string, start long, end long, depth long")
    got = learners.gc_windows(spark.createDataFrame([("c", seq)], "chrom string, seq string"), df)
    every = [*rows, ("c", 0, 100_000, 1)]
    want = [("c", at, seq[at : at + 50].count("G") + seq[at : at + 50].count("C"), sum(d for _, s, e, d in every for p in range(max(s, at), min(e, at + 50))) / 50) for at in range(0, 1000, 50)]
    assert sorted(map(tuple, got.collect())) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
