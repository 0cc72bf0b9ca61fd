"""Column functions on nucleotide strings, alignments, qualities and genotypes.

All are built-in expressions, so they stay in the JVM and in code generation where
Spark has it. Positions are 0-based unless a name says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")
TRINUCLEOTIDES = tuple(a + b + c for a in BASES for b in BASES for c in BASES)
#: Fixed values of the SAM format.
SAM_FLAGS = {
    "paired": 0x1, "proper": 0x2, "unmapped": 0x4, "mate_unmapped": 0x8, "reverse": 0x10, "mate_reverse": 0x20,
    "first": 0x40, "second": 0x80, "not_primary": 0x100, "low_quality": 0x200, "duplicate": 0x400, "supplementary": 0x800,
}


def reverse_complement(seq: Column) -> Column:
    """Reverse complement; N stays N."""
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def gc_count(seq: Column) -> Column:
    return 2 * F.char_length(seq) - sum((F.char_length(F.replace(seq, F.lit(b), F.lit(""))) for b in "GC"), F.lit(0))


def non_n_length(seq: Column) -> Column:
    return F.char_length(F.replace(seq, F.lit("N"), F.lit("")))


def trinucleotide(seq: Column, pos: Column) -> Column:
    """The base at ``pos`` with its neighbours."""
    return F.substring(seq, pos.cast("int"), F.lit(3))


def is_trinucleotide(tri: Column) -> Column:
    return tri.rlike("^[ACGT]{3}$")


def reg2bin(begin: Column, end: Column) -> Column:
    """The BAM index bin of the half-open interval: the deepest level that holds it whole."""
    last = end - 1
    out = F.lit(0).cast("long")
    for shift in (26, 23, 20, 17, 14):  # bins of 64 Mb down to 16 kb
        first_bin = ((1 << (29 - shift)) - 1) // 7
        fits = F.shiftright(begin, shift) == F.shiftright(last, shift)
        out = F.when(fits, F.shiftright(begin, shift) + first_bin).otherwise(out)
    return out


def sam_flag(names: Column) -> Column:
    """The sum of the distinct named flags of an array; unknown names count nothing."""
    values = F.create_map(*[F.lit(x) for kv in SAM_FLAGS.items() for x in kv])
    return F.aggregate(F.array_distinct(names), F.lit(0), lambda s, n: s + F.coalesce(F.try_element_at(values, n), F.lit(0)))


def cigar_runs(cigar: Column) -> Column:
    """A CIGAR string as array of struct(len, op)."""
    tokens = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0))
    return F.transform(tokens, lambda t: F.struct(F.regexp_extract(t, r"^\d+", 0).cast("int").alias("len"), F.right(t, F.lit(1)).alias("op")))


def cigar_expand(cigar: Column) -> Column:
    """One entry a read base; deleted bases are fused in front of the next entry (``DDM``)."""
    single = F.flatten(F.transform(cigar_runs(cigar), lambda r: F.array_repeat(r["op"], r["len"])))
    held = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("pending"))
    step = lambda s, op: F.when(
        op == "D", F.struct(s["out"].alias("out"), F.concat(s["pending"], op).alias("pending"))
    ).otherwise(F.struct(F.concat(s["out"], F.array(F.concat(s["pending"], op))).alias("out"), F.lit("").alias("pending")))
    return F.aggregate(single, held, step, lambda s: s["out"])


def cigar_compact(entries: Column) -> Column:
    """The CIGAR string of per-base entries; deletions before the first base are dropped."""
    flat = F.flatten(F.transform(entries, lambda e, i: F.split(F.when(i == 0, F.right(e, F.lit(1))).otherwise(e), "")))
    held = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit("").alias("op"))
    flush = lambda s: F.when(s["n"] > 0, F.concat(s["text"], s["n"].cast("string"), s["op"])).otherwise(s["text"])
    step = lambda s, op: F.when(
        s["op"] == op, F.struct(s["text"].alias("text"), (s["n"] + 1).alias("n"), s["op"].alias("op"))
    ).otherwise(F.struct(flush(s).alias("text"), F.lit(1).alias("n"), op.alias("op")))
    return F.aggregate(F.filter(flat, lambda c: c != ""), held, step, flush)


def cigar_length(cigar: Column, ops: str) -> Column:
    """Total length of the runs whose operation is one of ``ops``."""
    return F.aggregate(F.filter(cigar_runs(cigar), lambda r: r["op"].isin(*ops)), F.lit(0), lambda s, r: s + r["len"])


def cigar_packed(cigar: Column) -> Column:
    """Runs as the integers (len << 4) + op of the BAM format."""
    code = F.create_map(*[x for i, op in enumerate("MIDNSHP=X") for x in (F.lit(op), F.lit(i))])
    return F.transform(cigar_runs(cigar), lambda r: F.shiftleft(r["len"], 4) + F.element_at(code, r["op"]))


def phred_to_error(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10.0)


def error_to_phred(p: Column) -> Column:
    """The nearest whole quality, halves up."""
    return F.floor(-10.0 * F.log10(p) + 0.5).cast("int")


def decode_qualities(text: Column, offset: int = 33) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


def encode_qualities(q: Column, offset: int = 33) -> Column:
    return F.array_join(F.transform(q, lambda x: F.char(x + offset)), "")


def mask_low_quality(seq: Column, q: Column, threshold: int) -> Column:
    """Bases whose quality is at most the threshold become N."""
    bases = F.filter(F.split(seq, ""), lambda c: c != "")
    return F.array_join(F.zip_with(bases, q, lambda b, x: F.when(x <= threshold, F.lit("N")).otherwise(b)), "")


def info_value(info: Column, key: str) -> Column:
    """The value of ``key=`` in a ;-separated INFO string, else null."""
    return F.nullif(F.regexp_extract(info, rf"(?:^|;){key}=([^;]*)", 1), F.lit(""))


def first_info_value(info: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[info_value(info, k) for k in keys])


def format_value(fmt: Column, sample: Column, key: str) -> Column:
    """The sample's value of a :-separated FORMAT key, else null."""
    place = F.array_position(F.split(fmt, ":"), key)
    return F.when(place > 0, F.try_element_at(F.split(sample, ":"), place.cast("int")))


def genotype_alleles(gt: Column) -> Column:
    """Allele numbers of a genotype; a missing allele counts as the reference."""
    return F.transform(F.split(gt, r"[/|]"), lambda a: F.when(a == ".", F.lit(0)).otherwise(a.try_cast("int")))


def carriers(gt: Column) -> Column:
    """Numbers of the ploids that carry allele 1."""
    alleles = genotype_alleles(gt)
    return F.filter(F.transform(alleles, lambda a, i: F.when(a == 1, i)), lambda i: i.isNotNull())


def wp_string(ploids: Column, ploidy: int) -> Column:
    """``0/1``-like string with a 1 for each ploid that carries the variant."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(ploidy - 1)), lambda i: F.when(F.array_contains(ploids, i), "1").otherwise("0")), "/")


def common_suffix(a: Column, b: Column) -> Column:
    """Length of the longest suffix that can go while both keep a base."""
    most = F.least(F.char_length(a), F.char_length(b)) - 1
    at = lambda s, i: F.substring(s, (F.char_length(s) - i).cast("int"), F.lit(1))
    places = F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0), lambda n, i: F.when((n == i) & (at(a, i) == at(b, i)), n + 1).otherwise(n))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    most = F.least(F.char_length(a), F.char_length(b))
    at = lambda s, i: F.substring(s, i + 1, F.lit(1))
    places = F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0), lambda n, i: F.when((n == i) & (at(a, i) == at(b, i)), n + 1).otherwise(n))


def apply_variants(seq: Column, variants: Column) -> Column:
    """``seq`` with an array of struct(off, ref, alt), ascending and not overlapping, put in.

    One pass: what lies between variants is copied once, so no running offset is needed.
    """
    held = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, v: F.struct(
        F.concat(s["out"], F.substring(seq, s["at"] + 1, v["off"] - s["at"]), v["alt"]).alias("out"), (v["off"] + F.char_length(v["ref"])).alias("at")
    )
    return F.aggregate(variants, held, step, lambda s: F.concat(s["out"], F.substring(seq, s["at"] + 1, F.char_length(seq))))


def haplotype_cigar(length: Column, variants: Column) -> Column:
    """The alignment of ``apply_variants``'s result to the reference, as CIGAR string."""
    one = lambda n, op: F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise("")
    held = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"), F.lit(0).alias("match"))

    def step(s: Column, v: Column) -> Column:
        r, a = F.char_length(v["ref"]), F.char_length(v["alt"])
        both = F.least(r, a)
        match = s["match"] + (v["off"] - s["at"]) + both
        changed = F.concat(s["text"], one(match, "M"), one(a - both, "I"), one(r - both, "D"))
        return F.struct(F.when(r == a, s["text"]).otherwise(changed).alias("text"), (v["off"] + r).alias("at"), F.when(r == a, match).otherwise(F.lit(0)).alias("match"))

    return F.aggregate(variants, held, step, lambda s: F.concat(s["text"], one(s["match"] + length - s["at"], "M")))
