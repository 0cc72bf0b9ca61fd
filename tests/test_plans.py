"""Intervals, learners, comparison, simulation, files."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import intervals as iv
from strandloom.operators.chunks import bases_at, trinucleotide_counts
from strandloom.operators.variants import suffix_trimmed, validity
from strandloom.plans import compare, learners, simulate, validate
from strandloom.sources import bam, fastq, sinks, text

RND = random.Random(4)


def spans(spark, rows):
    return spark.createDataFrame(rows, "chrom string, start long, end long")


def test_interval_joins_equal_all_pairs(spark):
    a = [("c", s := RND.randrange(20_000), s + RND.randrange(0, 9000)) for _ in range(60)]
    b = [("c", s := RND.randrange(20_000), s + RND.randrange(1, 300)) for _ in range(60)]
    points = [("c", RND.randrange(25_000)) for _ in range(100)]
    got = sorted((r.chrom, r.pos, r.start, r.end) for r in iv.points_in_intervals(spark.createDataFrame(points, "chrom string, pos long"), spans(spark, a)).collect())
    assert got == sorted((c, p, s, e) for c, p in points for _, s, e in a if s <= p < e)
    got = sorted((r.start, r.end, r.r_start, r.r_end, r.overlap) for r in iv.overlaps(spans(spark, a), spans(spark, b)).collect())
    assert got == sorted((s, e, t, f, min(e, f) - max(s, t)) for _, s, e in a for _, t, f in b if s < f and t < e and e > s)


def test_edges_of_an_interval(spark):
    points = spark.createDataFrame([("c", p) for p in (9, 10, 19, 20)], "chrom string, pos long")
    assert sorted(r.pos for r in iv.points_in_intervals(points, spans(spark, [("c", 10, 20)]), "left_semi").collect()) == [10, 19]


def test_merge_complement_clusters_runs(spark):
    i = spans(spark, [("c", 1, 5), ("c", 5, 7), ("c", 9, 12), ("c", 10, 11), ("d", 0, 2)])
    assert sorted(map(tuple, iv.merge(i).select("chrom", "start", "end", "n").collect())) == [("c", 1, 7, 2), ("c", 9, 12, 2), ("d", 0, 2, 1)]
    lengths = spark.createDataFrame([("c", 15), ("d", 2), ("e", 3)], "chrom string, length long")
    assert sorted(map(tuple, iv.complement(i, lengths).collect())) == [("c", 0, 1), ("c", 7, 9), ("c", 12, 15), ("e", 0, 3)]
    p = spark.createDataFrame([("c", x) for x in (1, 5, 3000, 3001, 9000)], "chrom string, pos long")
    assert sorted((r["first"], r["last"]) for r in iv.gap_clusters(p, 2000).collect()) == [(1, 5), (3000, 3001), (9000, 9000)]
    s = spark.createDataFrame([("c", "NNACGNTN"), ("d", "ACGT")], "chrom string, seq string")
    assert sorted(map(tuple, iv.runs_of(s).collect())) == [("c", 0, 2), ("c", 5, 6), ("c", 7, 8)]


def test_trinucleotides_across_pieces(spark):
    seq = "".join(RND.choice("ACGTN") for _ in range(5000))
    s = spark.createDataFrame([("c", seq), ("e", ""), ("f", "AC")], "chrom string, seq string")
    want = {}
    for i in range(len(seq) - 2):
        want[seq[i : i + 3]] = want.get(seq[i : i + 3], 0) + 1
    got = dict(trinucleotide_counts(s).collect())
    assert len(got) == 64 and all(got[t] == want.get(t, 0) for t in got)
    p = spark.createDataFrame([("c", i) for i in (1, 1023, 1024, 1025, 4998)], "chrom string, pos long")
    assert {r.pos: r.around for r in bases_at(p, s).collect()} == {i: seq[i - 1 : i + 2] for i in (1, 1023, 1024, 1025, 4998)}


def test_variant_records(spark):
    v = spark.createDataFrame([("c", 0, "ACT", "AT"), ("c", 1, "N", "A"), ("c", 0, "G", "T"), ("c", 2, "C", "<X>"), ("c", 2, "C", "T")], "chrom string, pos long, ref string, alt string")
    assert suffix_trimmed(v).first()[2:4] == ("AC", "A")
    s = spark.createDataFrame([("c", "ANCTA")], "chrom string, seq string")
    assert [r.reason for r in sorted(validity(v.where("ref != 'ACT'"), s).collect(), key=lambda r: (r.pos, r.alt))] == ["ref_mismatch", "n_in_ref", "bad_alt", None]
    t = learners.trimmed(spark.createDataFrame([("c", 5, "AT", "A"), ("c", 5, "A", "AGG"), ("c", 5, "AC", "GT"), ("c", 5, "A", "C,G"), ("c", 5, "A", "G")], "chrom string, pos long, ref string, alt string"))
    assert sorted(map(tuple, t.select("pos", "ref", "alt").collect())) == [(5, "A", "G"), (6, "-", "GG"), (6, "T", "-")]
    assert sorted(r[0] for r in learners.indel_frequencies(t).select("size").collect()) == [-1, 2]


def test_regions_fold_from_the_right(spark):
    r = spark.createDataFrame([("c", 0, 10, 0.5), ("c", 8, 20, 0.25), ("c", 30, 40, 1.0)], "chrom string, start long, end long, density double")
    assert sorted(map(tuple, learners.merged_regions(r).collect())) == [("c", 0, 20, 0.375), ("c", 30, 40, 1.0)]


def test_quality_chain(spark):
    reads = spark.createDataFrame([([10, 20, 20],), ([10, 10, 20],), ([20, 20, 10],)], "q array<int>")
    got = {(r.pos, r.q_prev, r.q): r.p for r in learners.quality_transitions(reads).collect()}
    assert got[(1, 10, 20)] == 0.5 and got[(2, 20, 20)] == 0.5
    want = sum(10 ** (-q / 10) for r in reads.collect() for q in r.q) / 9
    assert abs(learners.mean_error(reads) - want) < 1e-12


def test_comparison(spark):
    schema = "chrom string, pos long, ref string, alt string"
    golden = spark.createDataFrame([("c", 5, "A", "G"), ("c", 5, "A", "T"), ("c", 9, "C", "T"), ("c", 20, "A", "AT")], schema)
    called = spark.createDataFrame([("c", 5, "A", "G"), ("c", 7, "G", "T"), ("c", 19, "CA", "CAT")], schema)
    assert tuple(compare.summary(golden, called).first())[:5] == (4, 3, 1, 2, 2)  # one position is solved
    missed, wrong = compare.missed_and_wrong(golden, called)
    seqs = spark.createDataFrame([("c", "TTTTTATGGCTTTTTTTTTCATTTT")], "chrom string, seq string")
    assert [(r.pos, r.n_missed) for r in compare.equivalents(missed.where("pos = 20"), wrong.where("pos = 19"), seqs).collect()] == [(19, 1)]
    flags = {r.pos: (r.unmappable, r.low_depth, r.unknown) for r in compare.attribution(missed, spans(spark, [("c", 8, 12)]), spans(spark, [("c", 0, 15)]).withColumn("depth", F.lit(50))).collect()}
    assert flags == {9: (True, False, False), 20: (False, False, True)}  # no depth is known of the second


@pytest.fixture(scope="module")
def sequences(spark):
    r = random.Random(8)
    rows = [(i, "".join(r.choice("ACGT") for _ in range(12_000))) for i in range(2)]
    return dict(rows), spark.createDataFrame(rows, "chrom long, seq string")


@pytest.mark.parametrize("fragment", [None, (200, 10)])
def test_reads_come_from_the_haplotypes(spark, sequences, fragment):
    seqs, df = sequences
    model = simulate.ReadModel(length=60, coverage=4.0, fragment=fragment, error_scale=0.0, ploidy=2, seed=2)
    made = simulate.simulate(df, simulate.MutationModel(rate=0.01, indel=0.3), model)
    variants = made["variants"].collect()
    assert len(variants) > 100 and all(seqs[v.chrom][v.pos : v.pos + len(v.ref)] == v.ref for v in variants)
    haps = made["haplotypes"].collect()
    for h in haps[:8]:
        mine = [v for v in h.variants]
        out, at, piece = "", 0, None
        window = next(w for w in made["windows"].collect() if (w.chrom, w.win) == (h.chrom, h.win))
        piece = seqs[h.chrom][window.start : window.end]
        for v in mine:
            out += piece[at : v.off] + v.alt
            at = v.off + len(v.ref)
        assert h.seq == out + piece[at:]
    reads = made["reads"].collect()
    bases = sum(len(s) for s in seqs.values())
    assert 0.7 * 4 * bases < 60 * len(reads) < 1.5 * 4 * bases
    names = {(h.chrom, h.win, h.ploid): h.seq for h in haps}
    for r in reads[:400]:
        c, w, p, _ = map(int, r.name.split("-")[1:])
        assert r.seq in names[(c, w, p)] and len(r.seq) == len(r.qual) == 60
        n = sum(int(x) for x, op in __import__("re").findall(r"(\d+)([MID])", r.cigar) if op in "MI")
        assert n == 60
        if r.cigar == "60M":
            window_ref = seqs[r.chrom][r.pos : r.pos + 60]
            assert sum(a != b for a, b in zip(r.seq, window_ref, strict=True)) < 12
    if fragment:
        assert {r.flag for r in reads} == {99, 147, 163, 83}
        tlen = [r.tlen for r in reads if r.tlen > 0]
        assert abs(sum(tlen) / len(tlen) - 200) < 10
    again = simulate.simulate(df.repartition(5), simulate.MutationModel(rate=0.01, indel=0.3), model)["reads"].collect()
    assert sorted(reads) == sorted(again)


def test_errors_follow_the_qualities(spark, sequences):
    _, df = sequences
    model = simulate.ReadModel(length=60, coverage=3.0, qualities=(10,), seed=5)
    made = simulate.simulate(df, simulate.MutationModel(rate=0.0), model)
    names = {(h.chrom, h.win, h.ploid): h.seq for h in made["haplotypes"].collect()}
    reads = [r for r in made["reads"].collect() if r.cigar == "60M"]
    seqs = sequences[0]
    wrong = sum(a != b for r in reads for a, b in zip(r.seq, seqs[r.chrom][r.pos : r.pos + 60], strict=True))
    assert names and 0.08 < wrong / (60 * len(reads)) < 0.12


def test_targets_and_given_variants(spark, sequences):
    seqs, df = sequences
    model = simulate.ReadModel(length=60, coverage=2.0)
    ref = seqs[0][3000]
    given = spark.createDataFrame([(0, 3000, ref, "A" if ref != "A" else "C", [0, 1])], "chrom long, pos long, ref string, alt string, ploids array<int>")
    made = simulate.simulate(df, simulate.MutationModel(rate=0.001), model, given, spark.createDataFrame([(0, 2900, 3100)], "chrom long, start long, end long"))
    assert made["variants"].where("pos = 3000").count() == 1
    assert all(r.chrom == 0 and (2900 <= r.pos < 3100 or 2900 <= r.pos + 60 < 3100) for r in made["reads"].collect())


def test_learned_models_drive_the_simulator(spark, sequences):
    seqs, df = sequences
    from strandloom.plans import models

    made = simulate.simulate(df, simulate.MutationModel(rate=0.02, indel=0.2, transition=1.0), simulate.ReadModel(length=60, coverage=1.0))
    v = learners.trimmed(made["variants"].select("chrom", "pos", "ref", "alt"))
    c = learners.snp_contexts(v, df)
    model = models.mutation_model(learners.rates(v, df), learners.mutation_probabilities(c, df), learners.mutation_spectrum(c), learners.indel_frequencies(v))
    assert 0.015 < model.rate < 0.022 and 0.15 < model.indel < 0.25 and 0.4 < model.insertion < 0.8
    q = spark.createDataFrame([([30, 20, 10],), ([30, 20, 20],)], "q array<int>")
    kinds, chain = models.quality_chain(learners.quality_marginals(q), learners.quality_transitions(q))
    reads = simulate.ReadModel(length=60, coverage=1.0, fragment_lengths=((50, 150, 160), (5.0, 1.0, 1.0)), qualities=kinds, chain=chain, error_scale=0.0)
    rates = spark.createDataFrame([(0, 0, 6000, 0.1)], "chrom long, start long, end long, rate double")
    again = simulate.simulate(df, model, reads, rates=rates, gc_scalars=[1.0] * 51, discard=spark.createDataFrame([(1, 0, 12_000)], "chrom long, start long, end long"))
    found = again["variants"].collect()
    dense = sum(x.chrom == 0 and x.pos < 6000 for x in found)
    assert dense > 2.5 * sum(x.chrom == 1 and x.pos < 6000 for x in found) > 0
    snps = [x for x in found if len(x.ref) == len(x.alt)]
    swap = {"A": "G", "G": "A", "C": "T", "T": "C"}
    assert sum(swap[x.ref] == x.alt for x in snps) > 0.6 * len(snps)  # mostly what was learned
    got = again["reads"].collect()
    assert got and {r.chrom for r in got} == {0} and all(r.qual[0] in "?5+" for r in got) and {abs(r.tlen) > 100 for r in got} == {True}


def test_ambiguous_bases(spark):
    from strandloom.operators.ambiguous import callable_parts, filled

    s = spark.createDataFrame([("c", "ANNCNNNNNG"), ("d", "ACGT")], "chrom string, seq string")
    got = dict(filled(s, 2).collect())
    assert got["d"] == "ACGT" and got["c"][3:] == "CNNNNNG" and set(got["c"][:3]) <= set("ACGT")
    assert dict(filled(s, 9, base="T").collect())["c"] == "ATTCTTTTTG"
    assert sorted(map(tuple, callable_parts(s, 3).collect())) == [("c", 0, 4), ("c", 9, 10), ("d", 0, 4)]


def test_model_ranges():
    for bad in ({"length": 5}, {"coverage": 0}, {"ploidy": 101}, {"fragment": (50, 1)}):
        with pytest.raises(ValueError):
            simulate.ReadModel(**bad)
    with pytest.raises(ValueError):
        simulate.MutationModel(rate=0.31)


def test_population(spark):
    got = simulate.population(10, 3, 0.5, 1, spark).collect()
    assert len(got) == 10 and {r.generation for r in got} == {3} and all(r.parent_id == r.member_id // 2 for r in got)


def test_members_of_a_population(spark, sequences):
    seqs, df = sequences
    model = simulate.MutationModel(rate=0.002, indel=0.3)
    once = {r.chrom: r.seq for r in simulate.mutated(df, model, 4, 1000).collect()}
    windows = simulate.window_plan(df.selectExpr("chrom", "0L AS start", "CAST(length(seq) AS LONG) AS end"), 1000, 0)
    drawn = simulate.without_conflicts(simulate.random_variants(windows, df, model, 1, 4), "ploids").collect()
    assert len(drawn) > 20
    for c, seq in seqs.items():  # the same variants put in one after the other, from the end
        for v in sorted((v for v in drawn if v.chrom == c), key=lambda v: -v.pos):
            assert seq[v.pos : v.pos + len(v.ref)] == v.ref
            seq = seq[: v.pos] + v.alt + seq[v.pos + len(v.ref) :]
        assert once[c] == seq
    genomes = simulate.population_genomes(df, 3, 2, 0.5, model, 5)
    rows = genomes.collect()
    assert len(rows) == 6 and len({r.member_id for r in rows}) == 3 and len({r.seq for r in rows}) == 6
    assert all(abs(len(r.seq) - 12_000) < 600 and set(r.seq) <= set("ACGT") for r in rows)
    assert sorted(simulate.population_genomes(df.repartition(3), 3, 2, 0.5, model, 5).collect()) == sorted(rows)
    one = rows[0].member_id
    own = {r.chrom: r.seq for r in rows if r.member_id == one}
    made = simulate.individual_reads(genomes, one, simulate.ReadModel(length=60, coverage=1.0, fragment=(200, 10), error_scale=0.0))
    reads = made["reads"].collect()
    assert made["variants"].count() == 0 and reads and all(own[r.chrom][r.pos : r.pos + 60] == r.seq for r in reads)


def test_records_regrouped_by_contig(spark):
    rows = spark.createDataFrame([("a_c2_x", 2, "GG"), ("b_c1", 1, "T"), ("a_c2", 1, "AC"), ("none", 3, "A"), (None, 4, "A")], "header string, place int, seq string")
    assert sorted(map(tuple, simulate.regrouped(rows, ["c1", "c2"]).collect())) == [("c1", "T"), ("c2", "ACGG")]


def test_errors_of_several_bases_keep_places(spark, sequences):
    """Every aligned base of a read that isn't a substitution stands where its CIGAR says, for both mates."""
    seqs, df = sequences
    model = simulate.ReadModel(length=80, coverage=4.0, fragment=(250, 10), qualities=(13,), indel_error=1.0, error_lengths=((1, 2, 3), (0.2, 0.3, 0.5)), seed=6)
    reads = simulate.simulate(df, simulate.MutationModel(rate=0.0), model)["reads"].collect()
    found, same, total = set(), 0, 0
    for r in reads:
        at, k = r.pos, 0
        for n, op in ((int(n), op) for n, op in __import__("re").findall(r"(\d+)([MID])", r.cigar)):
            if op == "M":
                same += sum(a == b for a, b in zip(r.seq[k : k + n], seqs[r.chrom][at : at + n], strict=True))
                total += n
            else:
                found.add((op, n, r.flag & 0x10))
            at, k = at + n * (op != "I"), k + n * (op != "D")
        assert k == 80 and "N" not in r.seq
    assert {(op, n, side) for op in "ID" for n in (1, 2, 3) for side in (0, 16)} <= found
    assert same / total > 0.99  # only errors at the ends and beside others are substitutions


def test_flags_of_reads_without_a_place(spark, tmp_path):
    """Inserted bases alone have no place on the reference: alone such a read stands where its mate does."""
    ins = "80I"
    frags = [(0, 0, 0, k, 500, off, 60, c, "A" * 40, "C" * 40) for k, (off, c) in enumerate([(0, "100M"), (0, "40I60M"), (0, "20M80I"), (0, ins)])]
    frags = spark.createDataFrame(frags, "chrom long, win long, ploid int, k int, start long, off int, size int, cigar string, left string, right string")
    model = simulate.ReadModel(length=40, fragment=(60, 5), error_scale=0.0)
    rows = {}
    made = simulate.read_records(frags, model)
    for r in made.collect():
        rows.setdefault(int(r.name.split("-")[-1]), []).append(r)
    kinds = {k: {r.flag & 0b1110 for r in rs} for k, rs in rows.items()}
    assert kinds == {0: {2}, 1: {4, 8}, 2: {4, 8}, 3: {12}} or kinds == {0: {2}, 1: {4, 8}, 2: {2}, 3: {12}}
    assert len({r.pos for r in rows[1]}) == 1 and all(r.tlen == 0 for k in (1, 3) for r in rows[k])
    assert {r.mapq for r in rows[1]} == {0, 70}
    sinks.write_sam(made, str(tmp_path / "s"))
    last = [int(line.split("\t")[1]) for line in "".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*"))).splitlines()]
    assert len(last) == 8 and [f & 12 == 12 for f in last] == [False] * 6 + [True] * 2


def test_text_files(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">chr1 first\nACgt\nNN\n>chr2|x\nGG\n")
    s = text.fasta(spark, str(tmp_path / "x.fa"))
    assert sorted(map(tuple, s.collect())) == [("chr1", "ACGTNN"), ("chr2", "GG")]
    assert sorted(map(tuple, text.fasta_index(s).collect())) == [("chr1", 6), ("chr2", 2)]
    (tmp_path / "x.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tNORMAL\tTUMOR\nc\t10\t.\tA\tG\t.\tPASS\tDP=3\tGT:DP\t0/1:4\t1/1:5\nc\t11\t.\tA\n")
    rows = text.vcf(spark, str(tmp_path / "x.vcf")).collect()
    assert rows[0].pos == 9 and rows[0].qual is None and rows[0].samples == {"NORMAL": "0/1:4", "TUMOR": "1/1:5"} and rows[1].malformed
    (tmp_path / "x.bed").write_text("track x\nc\t1\t9\tmut_rate=0.5;x\nc\t2\t3\tmut_rate=0.1\nd\t5\t8\n")
    b = text.bed(spark, str(tmp_path / "x.bed"))
    assert b.count() == 3 and [tuple(r) for r in text.mutation_rates(b).collect()] == [("c", 1, 9, 0.3)]
    (tmp_path / "x.fq").write_text("@a/1\nACGT\n+\nIIII\n@b/1\nACXT\n+\n@III\n@c/1\nAC\n+\n")
    f = fastq.read(spark, str(tmp_path / "x.fq"))
    assert dict(validate.tally(f).collect()) == {"ok": 1, "bad_base": 1, "missing_line": 1}
    (tmp_path / "x.sam").write_text("@HD\tx\nr\t99\tc\t5\t60\t1S3M\t=\t50\t49\tACGT\tI5+!\n")
    r = text.aligned_qualities(text.sam(spark, str(tmp_path / "x.sam"))).first()
    assert (r.pos, r.mate_pos, r.tlen, r.q) == (4, 49, 49, [20, 10, 0])
    (tmp_path / "x.depth").write_text("c\t1\t7.5\n")
    assert tuple(text.depth(spark, str(tmp_path / "x.depth")).first()) == ("c", 0, 1, 7.5)


def test_bam_round_trip(spark, tmp_path):
    rows = [(f"r{i}", 99, "c", i * 7 % 50, 60, "3M1I2M", "=", 80, 90, "ACGTNA", "IIIII!") for i in range(40)] + [("u", 4, None, -1, 0, "", None, -1, 0, "ACG", "III")]
    df = spark.createDataFrame(rows, bam.SCHEMA)
    bam.write(df, str(tmp_path / "out"), [("c", 1000)])
    got = sorted((r.name, r.flag, r.pos, r.cigar, r.seq, r.qual, r.mate_ref) for r in bam.read(spark, str(tmp_path / "out")).collect())
    assert got == sorted((n, f, p, c, s, q, "c" if m == "=" else m) for n, f, _, p, _, c, m, _, _, s, q in rows)
    path = next((tmp_path / "out").glob("*.bam"))
    assert bam.fault(str(path)) is None
    path.write_bytes(path.read_bytes()[:-10])
    assert "end-of-file" in bam.fault(str(path))


def test_sinks(spark, sequences, tmp_path):
    _, df = sequences
    made = simulate.simulate(df, simulate.MutationModel(), simulate.ReadModel(coverage=0.2))
    sinks.write_fastq(made["reads"], str(tmp_path / "fq"))
    assert validate.tally(fastq.read(spark, str(tmp_path / "fq"))).collect()[0].error == "ok"
    sinks.write_vcf(simulate.golden_vcf(made["variants"]), str(tmp_path / "vcf"))
    back = text.vcf(spark, str(tmp_path / "vcf"))
    assert back.count() == made["variants"].count() and back.where("malformed").count() == 0
    sinks.write_sam(made["reads"], str(tmp_path / "sam"))
    assert text.sam(spark, str(tmp_path / "sam")).count() == made["reads"].count()
    sinks.write_fasta(made["reads"], str(tmp_path / "fa"))
    assert text.fasta(spark, str(tmp_path / "fa")).count() == made["reads"].count()
    sinks.write_model({"v": made["variants"]}, str(tmp_path / "model"))
    assert sinks.read_model(spark, str(tmp_path / "model"), ["v"])["v"].count() == made["variants"].count()


def test_poisson_counts_of_any_rate(spark):
    from strandloom.plans.simulate import poisson_sum

    for rate in (0.5, 250.0, 800.0, 3000.0, 10000.0):
        got = spark.range(400).select(poisson_sum(F.lit(rate), "n", 1, F.col("id")).alias("n")).agg(F.avg("n"), F.variance("n")).first()
        assert abs(got[0] - rate) < 5 * (rate / 400) ** 0.5 and 0.7 < got[1] / rate < 1.4
