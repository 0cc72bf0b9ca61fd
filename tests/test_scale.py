"""Operators that work bin by bin against plain walks of the whole chromosome, and work in proportion to length."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from strandloom.operators import intervals as iv
from strandloom.operators import variants as vs
from strandloom.operators.chunks import chunked, trinucleotide_counts
from strandloom.plans import compare, simulate


def spans(n, seed, most=60_000):
    r = random.Random(seed)
    return [(r.choice("ab"), s := r.randrange(most), s + r.choice([1, 5, 300, 9000])) for _ in range(n)]


def merged(rows, touch):
    out = []
    for c, s, e in sorted(rows):
        if out and out[-1][0] == c and (s <= out[-1][2] if touch else s < out[-1][2]):
            out[-1] = (c, out[-1][1], max(e, out[-1][2]), out[-1][3] + 1)
        else:
            out.append((c, s, e, 1))
    return out


@pytest.mark.parametrize("touch", [True, False])
def test_unions_cross_bins(spark, touch):
    for seed in range(3):
        rows = spans(60, seed)
        got = iv.merge(spark.createDataFrame(rows, "chrom string, start long, end long"), touch)
        assert sorted(map(tuple, got.collect())) == merged(rows, touch)


def test_complement_crosses_bins(spark):
    rows = spans(12, 5)
    lengths = [("a", 80_000), ("b", 80_000), ("empty", 10)]
    want = []
    for c, n in lengths:
        at = 0
        for _, s, e, _ in (m for m in merged(rows, True) if m[0] == c):
            want += [(c, at, s)] * (s > at)
            at = e
        want += [(c, at, n)] * (n > at)
    got = iv.complement(spark.createDataFrame(rows, "chrom string, start long, end long"), spark.createDataFrame(lengths, "chrom string, length long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_clusters_numbers_and_moving_values_cross_bins(spark):
    r = random.Random(4)
    pos = sorted(r.sample(range(100_000), 300))
    df = spark.createDataFrame([("c", p, p % 11) for p in pos], "chrom string, pos long, v long").repartition(3)
    want, at = [], []
    for p in pos:
        if at and p - at[-1] > 900:
            want.append((at[0], at[-1], len(at)))
            at = []
        at.append(p)
    want.append((at[0], at[-1], len(at)))
    assert sorted((x["first"], x["last"], x["n"]) for x in iv.gap_clusters(df, 900).collect()) == want
    n = iv.numbered(df, "pos", [F.col("pos")])
    both = iv.shifted(iv.moving_sum(n, "v", 7, "ahead", stretch=16), "v", 9, "back", stretch=16)
    v = [p % 11 for p in pos]
    got = sorted((x["place"], x["ahead"], x["back"]) for x in both.collect())
    assert got == [(i, sum(v[i : i + 7]), v[i - 9] if i >= 9 else 0) for i in range(300)]
    mean = {x["pos"]: x["mean"] for x in iv.moving_mean(df, "pos", "v", 5000).collect()}
    assert all(abs(mean[p] - sum(q % 11 for q in pos if p <= q < p + 5000) / 5000) < 1e-12 for p in pos)


SCHEMA = "chrom string, pos long, ref string, alt string"


def test_only_applied_variants_block(spark):
    """Of a chain whose second one meets the first and the third, the first and the third stay."""
    chain = spark.createDataFrame([("c", 10, "ACG", "A"), ("c", 12, "GTT", "G"), ("c", 14, "T", "C"), ("c", 14, "TA", "T"), ("c", 40, "A", "T")], SCHEMA)
    assert sorted((v.pos, v.ref) for v in simulate.without_conflicts(chain).collect()) == [(10, "ACG"), (14, "TA"), (40, "A")]


def test_ploids_block_apart(spark):
    rows = [("c", 10, "ACG", "A", [0]), ("c", 11, "C", "T", [0, 1]), ("c", 12, "G", "T", [1]), ("c", 12, "GA", "G", [0])]
    got = simulate.without_conflicts(spark.createDataFrame(rows, SCHEMA + ", ploids array<int>"), "ploids")
    assert sorted((v.pos, v.ref, tuple(v.ploids)) for v in got.collect()) == [(10, "ACG", (0,)), (11, "C", (1,)), (12, "G", (1,))]


def test_conflicts_equal_a_list_of_taken_bases(spark):
    r = random.Random(6)
    rows = [("c", r.randrange(2000), "A" * r.choice([1, 1, 2, 5]), "C" * r.choice([1, 3]), [[0], [1], [0, 1]][r.randrange(3)]) for _ in range(500)]
    rows = list({x[:4]: x for x in rows}.values())
    taken, want = (set(), set()), {}
    for c, p, ref, alt, ploids in sorted(rows, key=lambda x: (x[1], len(x[2]) == len(x[3]), x[2], x[3])):
        for k in ploids:
            bases = set(range(p, p + len(ref)))
            if not bases & taken[k]:
                taken[k].update(bases)
                want.setdefault((p, ref, alt), []).append(k)
    got = simulate.without_conflicts(spark.createDataFrame(rows, SCHEMA + ", ploids array<int>").repartition(5), "ploids")
    assert {(v.pos, v.ref, v.alt): list(v.ploids) for v in got.collect()} == want


def test_pieces_take_time_in_proportion(spark):
    """A contig of five million bases is cut and counted in about ten times the time of one tenth of it."""
    unit = "".join(random.Random(1).choice("ACGTN") for _ in range(50_000))
    seconds = []
    for copies in (10, 100):
        seqs = spark.createDataFrame([("c", unit * copies)], "chrom string, seq string")
        began = time.time()
        assert chunked(seqs, 50, 0).count() == copies * 1000
        n = {r.tri: r.n for r in trinucleotide_counts(seqs).collect()}
        seconds.append(time.time() - began)
    text = unit * 2
    one = sum(text.startswith("ACG", i) for i in range(50_000))
    assert abs(n["ACG"] - 100 * one) <= 2 and seconds[1] < 60 and seconds[1] < 40 * max(seconds[0], 0.2)


def test_region_counts_equal_counting(spark):
    r = random.Random(3)
    seqs = {c: "".join(r.choice("ACGTN") for _ in range(n)) for c, n in (("a", 9000), ("b", 2), ("d", 5000))}
    regions = [("a", 0, 9000), ("a", 4090, 4100), ("a", 4094, 4096), ("d", 10, 4099), ("d", 7, 9), ("b", 0, 2)]
    want = {}
    for c, s, e in regions:
        for i in range(s, e - 2):
            want[seqs[c][i : i + 3]] = want.get(seqs[c][i : i + 3], 0) + 1
    df = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
    got = {x.tri: x.n for x in trinucleotide_counts(df, regions=spark.createDataFrame(regions, "chrom string, start long, end long")).collect()}
    assert len(got) == 64 and {t: n for t, n in got.items() if n} == {t: n for t, n in want.items() if "N" not in t}


def test_culls_keep_the_greatest_draws(spark):
    rows = [(i, (i * 7919 % 1000) / 1000) for i in range(700)] + [(1000 + i, 0.5) for i in range(40)]
    df = spark.createDataFrame(rows, "member_id long, u double")
    for keep in (1, 333, 380, 740):
        got = {r.member_id for r in simulate.most_drawn(df, keep, F.col("u"), "member_id").collect()}
        assert got == {i for i, _ in sorted(rows, key=lambda x: (-x[1], x[0]))[:keep]}


def test_alleles_of_the_last_record_first(spark):
    rows = [("c", 1, "A", "T", 1), ("c", 1, "A", "G", 2), ("c", 1, "A", "T", 3), ("c", 1, "A", "C", 0)]
    assert vs.merged_alleles(spark.createDataFrame(rows, SCHEMA + ", n int"), ["n"]).first().alt == "T,G,C"


def test_judged_counts_repeats_and_positions(spark):
    golden = spark.createDataFrame([("c", 1, "A", "T"), ("c", 1, "A", "T"), ("c", 2, "A", "C"), ("c", 2, "A", "C")], SCHEMA)
    called = spark.createDataFrame([("c", 1, "A", "T"), ("c", 1, "A", "G"), ("d", 2, "A", "C")], SCHEMA)
    assert tuple(compare.summary(golden, called).first()) == (4, 3, 1, 2, 1, 50.0, round(100 / 3, 6))
    missed, wrong = compare.missed_and_wrong(golden, called)
    assert [r.pos for r in missed.collect()] == [2, 2] and [r.chrom for r in wrong.collect()] == ["d"]
    assert tuple(compare.summary(golden.limit(0), called.limit(0)).first()) == (0, 0, 0, 0, 0, 0.0, 0.0)


def test_runs_cross_pieces(spark):
    r = random.Random(12)
    seqs = {f"c{i}": "".join(r.choice("ACGT" + "N" * 6) for _ in range(n)) for i, n in enumerate([1, 7, 50, 400])} | {"n": "N" * 333, "a": "A" * 90}
    want = []
    for c, s in seqs.items():
        at = None
        for i, x in enumerate(s + "A"):
            if x == "N" and at is None:
                at = i
            elif x != "N" and at is not None:
                want.append((c, at, i))
                at = None
    df = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
    for size in (1, 7, 64, 65_536):
        assert sorted(map(tuple, iv.runs_of(df, size=size).collect())) == sorted(want)


def test_runs_of_fifty_million_bases(spark):
    """Twice the runs of half the length: time in proportion to the bases, not to the square of the runs."""
    df = spark.createDataFrame([("c",)], "chrom string").withColumn("seq", F.repeat(F.lit("ACGTNNACGN"), 5_000_000))
    began = time.time()
    found = iv.runs_of(df).agg(F.count(F.lit(1)), F.sum(F.col("end") - F.col("start")), F.max("end")).first()
    assert tuple(found) == (10_000_000, 15_000_000, 50_000_000)
    assert time.time() - began < 120


def intervals_of_all_lengths(n, seed):
    r = random.Random(seed)
    return [(r.choice("ab"), s := r.randrange(3_000_000), s + r.choice([0, 1, 80, 4096, 5000, 70_000, 2_500_000]), i) for i in range(n)]


def test_joins_of_intervals_of_all_lengths(spark):
    schema = "chrom string, start long, end long, id long"
    left, right = intervals_of_all_lengths(150, 1), intervals_of_all_lengths(130, 2)
    got = iv.overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).select("id", "r_id", "overlap").collect()
    want = [(i, j, min(e, f) - max(s, t)) for c, s, e, i in left for d, t, f, j in right if c == d and s < f and t < e and s < e and t < f]
    assert sorted(map(tuple, got)) == sorted(want)
    points = [(c, s, i) for c, s, _, i in intervals_of_all_lengths(200, 3)] * 2
    df = spark.createDataFrame(points, "chrom string, pos long, point long")
    hits = [(p, i) for c, x, p in points for d, s, e, i in right if c == d and s <= x < e]
    inner = iv.points_in_intervals(df, spark.createDataFrame(right, schema)).select("point", "id").collect()
    assert sorted(map(tuple, inner)) == sorted(hits)
    outer = iv.points_in_intervals(df, spark.createDataFrame(right, schema), "left").select("point", "id").collect()
    missing = [(p, None) for c, x, p in points if not any(c == d and s <= x < e for d, s, e, _ in right)]
    assert sorted(map(tuple, outer), key=str) == sorted(hits + missing, key=str)
    semi = iv.points_in_intervals(df, spark.createDataFrame(right, schema), "left_semi").select("point").collect()
    assert sorted(r.point for r in semi) == sorted(p for c, x, p in points if any(c == d and s <= x < e for d, s, e, _ in right))
    none = spark.createDataFrame([], schema)
    assert iv.points_in_intervals(df, none, "left").count() == len(points) and iv.points_in_intervals(df, none).count() == 0


def test_long_intervals_have_few_copies(spark):
    """An interval lies in two bins of its level at most, whatever its length."""
    rows, levels = iv.at_home(spark.createDataFrame([("c", 0, 1 << k) for k in range(32)], "chrom string, start long, end long"))
    copies = rows.select(F.max(F.size(iv.met(iv.width_at(F.col("bin_level"), iv.BIN))))).first()[0]
    assert copies <= 2 and max(levels) <= iv.HIGHEST


@pytest.mark.parametrize("gathered", [20_000, 3])
def test_quantiles_are_exact(spark, monkeypatch, gathered):
    from strandloom.operators import statistics as st

    monkeypatch.setattr(st, "GATHERED", gathered)
    r = random.Random(3)
    columns = [[r.gauss(0, 1) for _ in range(501)], [1.0] * 400 + [2.0] * 3, [float(i % 3) for i in range(100)], [10.0 ** r.randint(-300, 300) for _ in range(90)], [5.0], [-0.0, 0.0, 1.0]]
    for xs in columns:
        df = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "v double").repartition(3)
        for share, got in zip((0, 0.03, 0.5, 0.95, 1), st.quantiles(df, "v", [0, 0.03, 0.5, 0.95, 1]), strict=True):
            at = share * (len(xs) - 1)
            a, b = (sorted(xs)[k] for k in (int(at), min(len(xs) - 1, int(at) + (at > int(at)))))
            assert got == pytest.approx(a + (b - a) * (at - int(at)), rel=1e-12)
    assert st.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_quantiles_of_many_values_gather_few(spark):
    from strandloom.operators import statistics as st

    df = spark.range(3_000_000).select((F.col("id") * 7919 % 3_000_000).alias("v"))
    assert st.quantiles(df, "v", [0.5, 0.97]) == [1_499_999.5, 0.97 * 2_999_999]


def test_regions_fold_from_the_right(spark):
    from strandloom.plans.learners import merged_regions

    r = random.Random(5)
    rows = [(r.choice("ab"), s := r.randrange(0, 90_000, 50), s + r.choice([50, 100, 700, 9000]), r.random()) for _ in range(300)]
    want = []
    for c in "ab":
        done = []
        for _, s, e, x in sorted((x for x in rows if x[0] == c), reverse=True):
            if done and e >= done[-1][1]:
                done[-1] = (c, s, done[-1][2], (x + done[-1][3]) / 2)
            else:
                done.append((c, s, e, x))
        want += done
    got = sorted(map(tuple, merged_regions(spark.createDataFrame(rows, "chrom string, start long, end long, density double")).collect()))
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and [x[3] for x in got] == pytest.approx([x[3] for x in sorted(want)])


def test_counters_come_with_the_records(spark):
    rows = [("c", i, "A", alt, f, gt) for i, (alt, f, gt) in enumerate([("G", "PASS", "0/1"), ("A", "PASS", "0/1"), (None, "PASS", "1/1"), ("G", "LowQual", "0/1"), ("G", None, "0/1"), ("G", ".", "0/0"), ("T", ".", "1|0")])]
    df = spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, filter string, gt string")
    kept, counted = vs.screened(df)
    assert sorted(r.pos for r in kept.collect()) == [6]
    assert counted.get == {"kept": 1, "no_variant": 2, "filtered": 2, "no_position": 1, "not_carried": 1}


def equal_haplotypes(missed, wrong, calls, seq, reach=50):
    """Those of the calls (and sizes of their missed sets) whose two sets, put into the sequence whole, give the same string."""
    found = []
    for call in calls:
        texts = []
        for side in (missed, wrong):
            near = sorted(v for v in side if v[0] < call[0] + reach + 1 and v[0] + len(v[1]) > call[0] - reach)
            at, out, fits = 0, "", bool(near)
            for pos, ref, alt in near:
                fits &= pos >= at and seq[pos : pos + len(ref)] == ref
                out, at = out + seq[at:pos] + alt, pos + len(ref)
            texts.append((out + seq[at:]) if fits else None)
            n = len(near) if side is missed else n
        if texts[0] is not None and texts[0] == texts[1]:
            found.append((*call, n))
    return sorted(found)


def test_equivalents_equal_whole_strings(spark):
    """Also across edges of bins, and where thousands of variants lie in one neighbourhood; no pairs of them are made."""
    r = random.Random(12)
    seq = "".join(r.choice("AACGT") for _ in range(9000))
    missed, wrong = set(), set()
    for i, at in enumerate([*range(290, 8800, 160), 4093, 8190]):
        pos, n = at + r.randrange(20), r.randrange(1, 4)
        alt = r.choice(["A", "C", seq[pos] + "GA", seq[pos]])
        missed.add((pos, seq[pos : pos + n], alt))
        if i % 3:
            wrong.add((pos - 1, seq[pos - 1 : pos + n], seq[pos - 1] + alt))
        if i % 7 == 0:
            wrong.add((pos + r.randrange(9, 60), "A", "T"))
        if i % 5 == 0:
            missed.add((pos + r.randrange(-55, 55), "A", "AC"))
    crowd = {(100 + i % 50, seq[100 + i % 50] + "C" * (i // 50), "T") for i in range(3000)}
    missed |= crowd
    wrong |= crowd
    frame = lambda rows: spark.createDataFrame([("c", *v) for v in rows], SCHEMA)
    got = compare.equivalents(frame(missed), frame(wrong), spark.createDataFrame([("c", seq)], "chrom string, seq string"))
    want = equal_haplotypes(missed, wrong, [v for v in wrong if v[0] > 250], seq)
    assert len(want) > 10
    assert sorted((v.pos, v.ref, v.alt, v.n_missed) for v in got.collect()) == want
    assert len(re.findall(r"\bJoin\b", got._jdf.queryExecution().optimizedPlan().toString())) == 1  # with the sequence


@pytest.mark.parametrize("crowd", [0.2, 3.0])
def test_conflicts_across_bins_equal_one_fold(spark, crowd):
    """Runs that reach over the edges of bins, and variants longer than a bin, give what one pass along the chromosome gives; one shuffle of the rows."""
    r = random.Random(9)
    rows = [("c", r.randrange(20_000), "A" * r.choice([1, 2, 5, 40]), r.choice("CG"), r.choice([[0], [1], [0, 1]])) for _ in range(int(20_000 * crowd / 10))]
    rows += [("c", 4090, "A" * 20, "T", [0, 1]), ("c", 8000, "A" * 9000, "C", [1]), ("c", 8190, "AA", "G", [0]), ("c", 8190, "AA", "G", [1])]
    reach, want = {}, {}
    for _, p, ref, alt, ploids in sorted(rows, key=lambda x: (x[1], len(x[2]) == len(x[3]), x[2], x[3])):
        for k in ploids:
            if p >= reach.get(k, 0):
                reach[k] = p + len(ref)
                want.setdefault((p, ref, alt), set()).add(k)
    got = simulate.without_conflicts(spark.createDataFrame(rows, SCHEMA + ", ploids array<int>").repartition(5), "ploids")
    assert sorted((v.pos, v.ref, v.alt, v.ploids) for v in got.collect()) == sorted((*v, sorted(k)) for v, k in want.items())
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum("Exchange hashpartitioning(chrom" in x and ", bin" in x and "Reused" not in x for x in plan.splitlines()) == 1
