"""Reads made as arrays against reads made one by one."""

import re
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.random import cumulative
from strandloom.plans import reads, simulate

HAPS = "chrom string, win long, ploid int, start long, seq string, cigar string"


def uniform(*key):
    return int(md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16) / 4294967296.0


def one_by_one(hap, model, scalars, keys, tile=50):
    """name, mate, pos, cigar, seq, qual, flag, mapq, mate_pos, tlen of a haplotype's reads, each by its own steps."""
    chrom, win, ploid, start, seq, cigar = hap
    runs = [(int(n), op) for n, op in re.findall(r"(\d+)([MID])", cigar)]
    cum = [0.0]
    for i in range(max((len(seq) - model.span) // tile, 0) + 1):
        cum.append(cum[-1] + (scalars or [1.0] * (tile + 1))[len(re.findall("[GC]", seq[i * tile : (i + 1) * tile]))])
    out, n = [], model.length
    if len(seq) < model.span or cum[-1] <= 0:
        return out
    for k in range(1, int(len(seq) * (model.coverage / model.ploidy / (n * (1 + model.paired)))) + 2):
        u = lambda what, k=k: uniform("read", model.seed, what, chrom, win, ploid, k)
        size = n
        if model.paired:
            values, weights = model.lengths()
            size = values[sum(c <= u("size") for c in cumulative(weights)) - 1]
        size = min(size, len(seq))
        off = min((sum(c <= u("tile") * cum[-1] for c in cum) - 1) * tile + int(u("off") * tile), len(seq) - size)
        swap = uniform("strand", model.seed, chrom, win, ploid, k) < 0.5
        made, lost, sides = [], [], (0, 1)[: 1 + model.paired]
        for s in sides:
            key = np.array([keys[k]], np.int64).view(np.uint64) + np.uint64(7919 * s)
            q, e, v = reads.quality_chains(key, model)[0], reads.hashed_uniform(key, 3, n)[0], reads.hashed_uniform(key, 4, n)[0]
            low = max(off + size - n - reads.SPARE, 0) if s else off
            text = seq[low : off + size] if s else seq[off : off + n + reads.SPARE]
            ref, whole = reads.slice_cigar(runs, low, len(text))
            got, ops = reads.with_errors(text[::-1] if s else text, whole[::-1] if s else whole, q, e, v, model)
            if s:
                got, ops, q = got[::-1], ops[::-1], q[::-1]
                ref += sum(o != "I" for o in whole) - sum(o != "I" for o in ops)
            if model.mask_below is not None:
                got = "".join("N" if x <= model.mask_below else b for b, x in zip(got, q, strict=True))
            made.append((start + ref, reads.compact(ops), got, "".join(chr(33 + x) for x in q)))
            lost.append("M" not in ops)
        at = [m[0] for m in made]
        span = 0 if any(lost) else at[-1] - at[0] + n
        if sum(lost) == 1 and model.paired:
            at = [at[lost.index(False)]] * 2
        for s in sides:
            second = model.paired and s != swap
            flag = 16 * swap + 4 * lost[s]
            if model.paired:
                flag = 1 + (128 if second else 64) + (16 if s else 32) + 8 * lost[1 - s] + 2 * (not any(lost)) + 4 * lost[s]
            out.append((f"sim-{chrom}-{win}-{ploid}-{k}", 1 + second, at[s], *made[s][1:], flag, 0 if lost[s] else 70, at[1 - s] if model.paired else None, (-span if s else span) if model.paired else 0))
    return out


MODELS = [
    (simulate.ReadModel(length=50, coverage=20.0, fragment=(150, 10), seed=3), None),
    (simulate.ReadModel(length=30, coverage=20.0, seed=5, indel_error=0.5, mask_below=10, error_lengths=((1, 2, 3), (0.2, 0.3, 0.5))), [0.0] * 20 + [1.5] * 31),
    (simulate.ReadModel(length=40, coverage=20.0, fragment_lengths=((30, 45, 60, 90), (1.0, 1.0, 2.0, 1.0)), seed=7, qualities=(5, 12), stay=0.5), [1.0 + i / 7 for i in range(51)]),
]


@pytest.mark.parametrize("model, scalars", MODELS)
def test_arrays_equal_reads_one_by_one(spark, model, scalars):
    r = np.random.default_rng(1)
    text = lambda n: "".join(r.choice(list("AACCGGTTN"), n))
    haps = [("c", 0, 0, 0, text(900), "900M"), ("c", 0, 1, 0, text(905), "200M60I300M7D345M"), ("c", 1, 0, 885, text(700), "30I670M"), ("d", 0, 0, 0, text(151), "80M1D71M"), ("e", 0, 1, 0, text(20), "20M"), ("f", 2, 0, 9, "A" * 300, "300I")]
    df = spark.createDataFrame(haps, HAPS)
    got = simulate.sampled_reads(df, model, scalars).select("name", "mate", "pos", "cigar", "seq", "qual", "flag", "mapq", "mate_pos", "tlen")
    want = []
    for hap in haps:
        one = spark.range(1, 2000).select(F.lit(hap[0]).alias("chrom"), F.lit(hap[1]).cast("long").alias("win"), F.lit(hap[2]).alias("ploid"), F.col("id").cast("int").alias("k"))
        keys = dict(one.select("k", F.xxhash64(F.lit(model.seed), "chrom", "win", "ploid", "k")).collect())
        want += one_by_one(hap, model, scalars, keys)
    assert len(want) > 300 and len({w[3] for w in want}) > 3
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_windows_are_cut_without_a_join(spark):
    seqs = spark.createDataFrame([("a", "ACGTN" * 901), ("b", "AC"), ("c", ""), ("d", None)], "chrom string, seq string")
    regions = seqs.select("chrom", F.lit(0).cast("long").alias("start"), F.char_length("seq").cast("long").alias("end"))
    got = simulate.window_pieces(seqs, 1000, 30)
    assert sorted(map(tuple, got.drop("piece").collect())) == sorted(map(tuple, simulate.window_plan(regions, 1000, 30).collect()))
    text = {r.chrom: r.seq for r in seqs.collect()}
    assert all(w.piece == text[w.chrom][w.start : w.end] for w in got.collect())
    variants = spark.createDataFrame([("a", 3, 3381, "CG", "C", [0]), ("a", 3, 3390, "A", "T", [1])], "chrom string, win long, pos long, ref string, alt string, ploids array<int>")
    haps = simulate.window_haplotypes(got, variants, 2)
    assert {(h.chrom, h.win, h.ploid): h.cigar for h in haps.collect() if "D" in h.cigar} == {("a", 2, 0): "1130M1D25M", ("a", 3, 0): "4M1D1122M"}
    assert len(re.findall(r"\bJoin\b", haps._jdf.queryExecution().optimizedPlan().toString())) == 1


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fastq_lines_of_reads_as_arrays(spark):
    """The four lines of each read, with those of the reverse strand turned back; rows never pass Python one by one."""
    made = simulate.sampled_reads(spark.createDataFrame([("c", 0, 0, 0, "ACGTTGCAAC" * 40, "400M")], HAPS), MODELS[0][0])
    want = []
    for r in made.collect():
        back = r.flag & 16
        seq, qual = (r.seq[::-1].translate(str.maketrans("ACGTN", "TGCAN")), r.qual[::-1]) if back else (r.seq, r.qual)
        want.append(f"@{r.name}/{r.mate}\n{seq}\n+\n{qual}")
    lines = simulate.fastq_lines(made)
    assert len(want) > 60 and sorted(r.value for r in lines.collect()) == sorted(want)
    assert "MapInPandas" not in plan_of(lines) and "MapInArrow" in plan_of(lines)


def test_sam_lines_of_reads_as_arrays(spark):
    made = simulate.sampled_reads(spark.createDataFrame([("c", 0, 1, 70, "ACGTTGCAAC" * 40, "200M10D200M")], HAPS), MODELS[0][0])
    want = ["\t".join(map(str, (r.name, r.flag, r.chrom, r.pos + 1, r.mapq, r.cigar, "=", r.mate_pos + 1, r.tlen, r.seq, r.qual))) for r in made.collect()]
    lines = simulate.sam_lines(made).select("value")
    assert any("10D" in w for w in want) and sorted(r.value for r in lines.collect()) == sorted(want)
    assert "MapInPandas" not in plan_of(lines) and "MapInArrow" in plan_of(lines)
