"""Column functions on hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from strandloom.functions import random as rnd
from strandloom.functions.sequence import (
    apply_variants, carriers, cigar_compact, cigar_expand, cigar_length, cigar_packed, common_prefix, common_suffix, decode_qualities, encode_qualities, error_to_phred, first_info_value, format_value, gc_count, haplotype_cigar,
    info_value, mask_low_quality, reg2bin, reverse_complement, sam_flag, wp_string,
)
from strandloom.operators.statistics import cdf_knots, median_and_deviation, nearest_knot, weighted_median_index
from strandloom.operators.variants import allele_frequencies, depth, frequency_class, genotype, population_frequency


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: reverse_complement(F.lit("AACGN")), "NCGTT"),
        (lambda: gc_count(F.lit("GATTACAC")), 3),
        (lambda: reg2bin(F.lit(0).cast("long"), F.lit(100).cast("long")), 4681),
        (lambda: reg2bin(F.lit(0).cast("long"), F.lit(1 << 27).cast("long")), 0),
        (lambda: sam_flag(F.array(*map(F.lit, ("paired", "proper", "first", "mate_reverse")))), 99),
        (lambda: sam_flag(F.array(*map(F.lit, ("paired", "proper", "second", "reverse", "reverse", "unknown")))), 147),
        (lambda: cigar_expand(F.lit("2M1I3D1M")), ["M", "M", "I", "DDDM"]),
        (lambda: cigar_compact(F.array(*map(F.lit, ("M", "M", "I", "DDM", "M")))), "2M1I2D2M"),
        (lambda: cigar_compact(F.array(F.lit("DM"), F.lit("M"))), "2M"),
        (lambda: cigar_compact(cigar_expand(F.lit("10M1I3D1M"))), "10M1I3D1M"),
        (lambda: cigar_length(F.lit("10M1I3D1M"), "MI"), 12),
        (lambda: cigar_packed(F.lit("2M1I")), [32, 17]),
        (lambda: decode_qualities(F.lit("!+5")), [0, 10, 20]),
        (lambda: encode_qualities(F.array(F.lit(0), F.lit(40))), "!I"),
        (lambda: error_to_phred(F.lit(0.001)), 30),
        (lambda: mask_low_quality(F.lit("ACG"), F.array(F.lit(1), F.lit(2), F.lit(3)), 2), "NNG"),
        (lambda: info_value(F.lit("DP=3;AF=0.5"), "AF"), "0.5"),
        (lambda: info_value(F.lit("XAF=1;DP=3"), "AF"), None),
        (lambda: first_info_value(F.lit("DPU=4;DPI=7"), ("DP", "DPU", "DPI")), "4"),
        (lambda: format_value(F.lit("GT:DP"), F.lit("0/1:9"), "DP"), "9"),
        (lambda: carriers(F.lit("0|1")), [1]),
        (lambda: carriers(F.lit("./1/1")), [1, 2]),
        (lambda: wp_string(F.array(F.lit(1)), 2), "0/1"),
        (lambda: common_suffix(F.lit("ACT"), F.lit("AT")), 1),
        (lambda: common_suffix(F.lit("T"), F.lit("AT")), 0),
        (lambda: common_prefix(F.lit("ACT"), F.lit("ACG")), 2),
        (lambda: weighted_median_index(F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5))), 1),
        (lambda: rnd.draw(F.lit(0.61), [7, 8, 9], [0.3, 0.3, 0.4]), 9),
        (lambda: rnd.draw(F.lit(0.6), [7, 8], [0.0, 0.0]), 7),
        (lambda: frequency_class(F.lit(-0.1)), 0),
        (lambda: frequency_class(F.lit(0.5)), 10),
        (lambda: frequency_class(F.lit(1.0)), 20),
        (lambda: allele_frequencies(F.lit("AF=0.1,0.2"), F.lit(3)), [0.1, 0.2, 0.2]),
        (lambda: allele_frequencies(F.lit("AF=."), F.lit(1)), [None]),
        (lambda: depth(F.lit("X=1"), F.lit("GT:DPI"), F.lit("0/1:12")), 12),
        (lambda: population_frequency(F.lit("CAF=0.9,0.1")), 0.1),
        (lambda: population_frequency(F.lit("DP=1")), 1e-5),
        (lambda: genotype(F.lit("WP=1/0;GT=0/1")), "1/0"),
    ],
)
def test_expression(spark, column, want):
    assert value(spark, column()) == want


def test_variants_into_a_string(spark):
    v = "array(named_struct('off', 1, 'ref', 'C', 'alt', 'CTT'), named_struct('off', 3, 'ref', 'TA', 'alt', 'T'))"
    assert value(spark, apply_variants(F.lit("ACGTAG"), F.expr(v))) == "ACTTGTG"
    assert value(spark, haplotype_cigar(F.lit(6), F.expr(v))) == "2M2I2M1D1M"


def test_statistics(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 4, 6, 8, 12, 14, 15, 17, 21)], "x int")
    assert tuple(median_and_deviation(df, "x").first()) == (10.0, 5.5)
    assert tuple(median_and_deviation(spark.createDataFrame([(0,), (2,)], "x int"), "x").first()) == (1.0, 1.0)
    dist = spark.createDataFrame([(v, 0.1) for v in range(10)], "v int, p double")
    assert sorted(r[0] for r in cdf_knots(dist, "v", "p").collect()) == list(range(10))
    got = {r.v: r.knot for r in nearest_knot(dist, "v", [0, 4]).collect()}
    assert got[2] == 0 and got[3] == 4


def test_draws_do_not_depend_on_partitions(spark):
    u = rnd.uniform("x", F.col("id"))
    a = spark.range(500).select("id", u.alias("u")).collect()
    b = spark.range(500).repartition(7).select("id", u.alias("u")).orderBy("id").collect()
    assert a == b and abs(sum(r.u for r in a) / 500 - 0.5) < 0.05
    assert abs(sum(rnd.poisson_weights(3.0, 40)) - 1) < 1e-9
    assert len(value(spark, rnd.random_dna(F.lit(30), "s"))) == 30
