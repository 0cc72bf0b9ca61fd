"""Whole programs on small files, against the learners on whole sequences and values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom import programs
from strandloom.operators import variants as vs
from strandloom.plans import learners
from strandloom.sources import bam, fastq, text

RND = random.Random(11)
C1 = "".join(RND.choice("ACGT") for _ in range(700)) + "C" + "A" * 10 + "G" + "".join(RND.choice("ACGT") for _ in range(300))
C2 = "".join(RND.choice("ACGTN") for _ in range(900))
OTHER = {"A": "C", "C": "G", "G": "T", "T": "A"}


def folded(seqs, width=70):
    return "".join(f">{n} some text\n" + "".join(s[i : i + width] + "\n" for i in range(0, len(s), width)) for n, s in seqs.items())


def line(chrom, pos, ref, alt, info=".", filter_="PASS"):
    return f"{chrom}\t{pos + 1}\t.\t{ref}\t{alt}\t.\t{filter_}\t{info}"


HEAD = "##fileformat=VCFv4.1\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"


@pytest.fixture(scope="module")
def reference(tmp_path_factory):
    path = tmp_path_factory.mktemp("ref") / "ref.fa"
    path.write_text(folded({"c1": C1, "c2": C2, "c3": "ACGT" * 30}))
    return str(path)


@pytest.fixture(scope="module")
def variants(tmp_path_factory):
    rows = []
    for chrom, seq in (("c1", C1), ("c2", C2), ("nowhere", C2)):
        for pos in RND.sample(range(1, len(seq) - 3), 60):
            base = seq[pos]
            if base != "N":
                kind = pos % 5
                ref, alt = (seq[pos : pos + 3], base) if kind == 0 and "N" not in seq[pos : pos + 3] else (base, base + "GA") if kind == 1 else (base, f"{OTHER[base]},{base}T") if kind == 2 and pos % 3 == 0 else (base, OTHER[base])
                rows.append(line(chrom, pos, ref, alt, f"CAF=0.9,0.{pos % 90}" if pos % 2 else "."))
    path = tmp_path_factory.mktemp("vcf") / "x.vcf"
    path.write_text(HEAD + "\n".join(rows) + "\nbroken\tline\n")
    return str(path)


def rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("bed", [None, "c1\t10\t400\tx\nc1\t300\t800\ty\nc2\t0\t5000\tz\nelsewhere\t1\t9\tq\n"])
def test_mutation_model_equals_the_learners_on_whole_sequences(spark, tmp_path, reference, variants, bed):
    regions = None
    if bed:
        (tmp_path / "x.bed").write_text(bed)
        regions = str(tmp_path / "x.bed")
    got = programs.learn_mutations(spark, reference=reference, variants=variants, output=str(tmp_path / "model"), regions=regions)
    seqs = text.fasta(spark, reference).where("chrom in ('c1', 'c2')")
    targets = text.bed(spark, regions).where("chrom in ('c1', 'c2')") if bed else None
    v = text.vcf(spark, variants).where("not malformed and chrom in ('c1', 'c2')").withColumn("freq", vs.population_frequency(F.col("info"))).select("chrom", "pos", "ref", "alt", "freq")
    v = learners.trimmed(v)
    if bed:
        v = v.where("(chrom = 'c1' and pos >= 10 and pos < 800) or chrom = 'c2'")
    contexts = learners.snp_contexts(v, seqs)
    assert rounded(got["transitions"]) == rounded(learners.mutation_spectrum(contexts))
    assert rounded(got["indels"]) == rounded(learners.indel_frequencies(v)) and got["indels"].count() > 1
    assert rounded(got["bases"]) == rounded(learners.base_transitions(contexts))
    assert rounded(got["rates"]) == rounded(learners.rates(v, seqs, targets))
    assert rounded(got["common"]) == rounded(learners.common_variants(v))
    if not bed:
        assert rounded(got["trinucleotides"]) == rounded(learners.mutation_probabilities(contexts, seqs))
    else:
        counted = {r["tri"]: r["n_ref"] for r in got["trinucleotides"].collect()}
        inside = [C1[10:800], C2]
        assert counted == {t: sum(s[i : i + 3] == t for s in inside for i in range(len(s))) for t in counted}
    left = dict(got["left_out"].collect())
    assert left["nowhere"] == ("reference,regions" if bed else "reference") and left["c3"] == ("regions,variants" if bed else "variants")


def test_gc_model(spark, tmp_path, reference):
    (tmp_path / "x.depth").write_text("".join(f"c1\t{i + 1}\t{i % 7}\n" for i in range(len(C1))))
    got = programs.learn_gc(spark, coverage=str(tmp_path / "x.depth"), reference=reference, output=str(tmp_path / "m"), window=20)
    want = learners.gc_bias(learners.gc_windows(text.fasta(spark, reference).where("chrom = 'c1'"), text.depth(spark, str(tmp_path / "x.depth")), 20), 20)
    assert rounded(got["gc"]) == rounded(want) and got["gc"].count() == 21
    assert dict(got["left_out"].collect()) == {"c2": "coverage", "c3": "coverage"}


@pytest.mark.parametrize("kind", ["sam", "bam"])
def test_fragment_model(spark, tmp_path, kind):
    rows = [(f"r{i}", 99, "c1", 5, 60, "4M", "c1", 60, 200 + i % 3 if i < 330 else 9000, "ACGT", "IIII") for i in range(440)] + [("x", 99, "c1", 5, 3, "4M", "c1", 60, 1, "ACGT", "IIII")]
    path = str(tmp_path / "in") if kind == "bam" else str(tmp_path / "x.sam")
    if kind == "bam":
        bam.write(spark.createDataFrame(rows, bam.SCHEMA), path, [("c1", 1000)])
    else:
        (tmp_path / "x.sam").write_text("@HD\tx\n" + "".join("\t".join(map(str, (n, f, c, p + 1, q, g, "=", m + 1, t, s, u))) + "\n" for n, f, c, p, q, g, _, m, t, s, u in rows))
    got = programs.learn_fragments(spark, reads=path, output=str(tmp_path / "m"))
    assert rounded(got["lengths"]) == [(110, round(1 / 3, 9), 200 + k) for k in range(3)]


def test_quality_model(spark, tmp_path):
    for mate in (1, 2):
        (tmp_path / f"{mate}.fq").write_text("".join(f"@r{i}/{mate}\nACGT\n+\n{'I5+!' if i % 2 else '@@II'}\n" for i in range(50)) + "@short/1\nAC\n+\nII\n")
    got = programs.learn_qualities(spark, reads=str(tmp_path / "1.fq"), reads2=str(tmp_path / "2.fq"), output=str(tmp_path / "m"))
    assert set(got) == {"marginals", "transitions", "marginals2", "transitions2", "error"}
    first = {(r["pos"], r["q"]): r["p"] for r in got["marginals"].collect()}
    assert first[0, 40] == 0.5 and first[0, 31] == 0.5 and first[3, 0] == 0.5
    few = programs.learn_qualities(spark, reads=str(tmp_path / "1.fq"), output=str(tmp_path / "few"), most_reads=1)
    assert [(r["pos"], r["q"]) for r in few["marginals"].orderBy("pos").collect()] == [(0, 31), (1, 31), (2, 40), (3, 40)]
    with pytest.raises(programs.BadInput, match="outside"):
        programs.learn_qualities(spark, reads=str(tmp_path / "1.fq"), output=str(tmp_path / "bad"), offset=64)


def test_comparison(spark, tmp_path, reference):
    snp = lambda pos, **k: line("c1", pos, C1[pos], OTHER[C1[pos]], **k)
    golden = [snp(100, info="DP=40"), snp(300, info="DP=3"), snp(500, info="DP=50"), line("c1", 700, "CA", "C", "DP=30"), snp(600, filter_="LowQual"), line("c1", 610, C1[610], "."), line("gone", 5, "A", "C")]
    called = [snp(100), snp(400), line("c1", 705, "AA", "A"), line("c1", 620, C1[620], OTHER[C1[620]], filter_="q10")]
    (tmp_path / "g.vcf").write_text(HEAD + "\n".join(golden) + "\n")
    (tmp_path / "w.vcf").write_text(HEAD + "\n".join(called) + "\n")
    (tmp_path / "map.bed").write_text("c1\t480\t520\t150\nc1\t290\t310\t20\n")
    args = {"reference": reference, "golden": str(tmp_path / "g.vcf"), "called": str(tmp_path / "w.vcf"), "mappability": str(tmp_path / "map.bed"), "mappability_least": 100}
    got = programs.compare_calls(spark, output=str(tmp_path / "out"), vcf_out=True, **args)
    assert got["summary"].first().asDict() == {"n_golden": 4, "n_called": 3, "n_missed": 2, "n_wrong": 1, "n_equivalent": 1, "in_short": 0, "n_unmappable": 1, "n_low_depth": 1, "n_unknown": 0}
    lines = lambda name: "".join(p.read_text() for p in sorted((tmp_path / "out" / name).glob("part-*"))).splitlines()
    assert lines("missed_vcf") == [golden[1], golden[2]] and lines("wrong_vcf") == [called[1]]
    assert dict(got["left_out"].collect()) == {"c2": "called,golden", "c3": "called,golden", "gone": "called,reference"}
    fast = programs.compare_calls(spark, output=str(tmp_path / "fast"), fast=True, **args)["summary"].first()
    assert (fast.n_missed, fast.n_wrong, fast.n_equivalent) == (3, 2, 0)
    (tmp_path / "t.bed").write_text("c1\t90\t450\nc1\t495\t505\n")
    some = programs.compare_calls(spark, output=str(tmp_path / "some"), targets=str(tmp_path / "t.bed"), targets_least=50, **args)["summary"].first()
    assert (some.n_golden, some.n_called, some.n_missed, some.n_wrong, some.in_short) == (2, 2, 1, 1, 1)


def test_arguments_are_checked(spark, tmp_path, reference, variants):
    out = str(tmp_path / "m")
    with pytest.raises(programs.BadInput, match="missing: variants"):
        programs.learn_mutations(spark, reference=reference, variants=None, output=out)
    with pytest.raises(programs.BadInput, match="reference: .* can't be read"):
        programs.learn_mutations(spark, reference=str(tmp_path / "no.fa"), variants=variants, output=out)
    (tmp_path / "y.vcf").write_text(HEAD + line("chr9", 4, "A", "C") + "\n")
    with pytest.raises(programs.BadInput, match="spelt alike"):
        programs.learn_mutations(spark, reference=reference, variants=str(tmp_path / "y.vcf"), output=out)
    with pytest.raises(programs.BadInput, match="go together"):
        programs.compare_calls(spark, reference=reference, golden=variants, called=variants, output=out, targets="x")
    with pytest.raises(programs.BadInput, match="window = 0"):
        programs.learn_gc(spark, coverage=variants, reference=reference, output=out, window=0)
    with pytest.raises(programs.BadInput, match="neither .sam nor .bam"):
        programs.learn_fragments(spark, reads=variants, output=out)
    assert fastq.SCHEMA and not (tmp_path / "m").exists()
