"""Oracle SQL (DuckDB) for the registered queries, written apart from the plans."""

from __future__ import annotations

from strandloom.derived import ALIGNMENTS_SQL, CALLS_SQL, CONTIGS_SQL, INTERVALS_SQL, QUALITIES_SQL, VARIANTS_SQL, uniform_sql
from strandloom.functions.random import cumulative, normal_lengths, poisson_weights

TRI = "(SELECT a.b || m.b || c.b AS tri FROM bases a, bases m, bases c)"
BASES = "bases AS (SELECT unnest(['A', 'C', 'G', 'T']) AS b)"
RECORDS = f"""{VARIANTS_SQL},
records AS (SELECT chrom, pos, ref, l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_partkey % 5 = 0 THEN alt || ',' || ref || 'A' ELSE alt END AS alt,
  CASE l_returnflag WHEN 'N' THEN 'PASS' WHEN 'A' THEN '.' ELSE 'LowQual' END AS filter,
  l_suppkey AS depth, CASE WHEN l_partkey % 3 > 0 THEN '0.' || l_linenumber END AS af,
  CASE WHEN l_partkey % 2 = 0 THEN CAST('0.' || (l_partkey % 97) AS DOUBLE) ELSE 1e-5 END AS freq,
  l_partkey % 2 AS g1, CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE l_suppkey % 2 END AS g2,
  (l_partkey % 2) || CASE WHEN l_suppkey % 2 = 0 THEN '|' ELSE '/' END || CASE WHEN l_suppkey % 7 = 0 THEN '.' ELSE CAST(l_suppkey % 2 AS VARCHAR) END AS gt
  FROM variants)"""
LEARNED = f"""{VARIANTS_SQL},
learned AS (SELECT chrom, l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN length(ref) <> length(alt) THEN pos + 1 ELSE pos END AS pos,
  CASE WHEN length(ref) = length(alt) THEN ref WHEN length(ref) = 1 THEN '-' ELSE substr(ref, 2) END AS ref,
  CASE WHEN length(ref) = length(alt) THEN alt WHEN length(alt) = 1 THEN '-' ELSE substr(alt, 2) END AS alt FROM variants)"""
CONTEXTS = f"""{LEARNED}, {BASES},
around AS (SELECT l.*, substr(c.seq, l.pos, 3) AS tri_ref FROM learned l JOIN contigs c USING (chrom) WHERE ref <> '-' AND alt <> '-'),
contexts AS (SELECT *, left(tri_ref, 1) || alt || right(tri_ref, 1) AS tri_alt FROM around
  WHERE regexp_full_match(tri_ref, '[ACGT]{{3}}') AND regexp_full_match(alt, '[ACGT]') AND substr(tri_ref, 2, 1) = ref)"""
TRI_COUNTS = "SELECT tri, count(*) AS n FROM (SELECT substr(seq, i, 3) AS tri FROM (SELECT seq, unnest(range(1, length - 1)) AS i FROM contigs)) GROUP BY tri"
TILES = f"""{INTERVALS_SQL},
tiles AS (SELECT chrom, s AS start, s + 50 AS "end", substr(seq, s + 1, 50) AS piece FROM (SELECT chrom, seq, unnest(range(0, length - 49, 50)) AS s FROM contigs)),
good AS (SELECT chrom, start, "end", length(regexp_replace(piece, '[^GC]', '', 'g')) AS gc FROM tiles WHERE NOT contains(piece, 'N')),
covered AS (SELECT g.chrom, g.start, sum((least(g."end", i."end") - greatest(g.start, i.start)) * (o_orderkey % 5 + 1)) AS bases
  FROM good g JOIN intervals i ON g.chrom = i.chrom AND g.start < i."end" AND i.start < g."end" GROUP BY ALL),
windows AS (SELECT g.*, coalesce(bases, 0) / 50 AS depth FROM good g LEFT JOIN covered USING (chrom, start))"""
MERGED = """SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n FROM (
  SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT chrom, start, "end", max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source})) GROUP BY chrom, island"""
RUNS = f"""{CONTIGS_SQL},
letters AS (SELECT chrom, i, substr(seq, i + 1, 1) = 'N' AS is_n FROM (SELECT chrom, seq, unnest(range(0, length)) AS i FROM contigs)),
runs AS (SELECT chrom, min(i) AS start, max(i) + 1 AS "end" FROM (SELECT chrom, i, i - row_number() OVER (PARTITION BY chrom ORDER BY i) AS g FROM letters WHERE is_n) GROUP BY chrom, g)"""
CALLABLE = f"""{RUNS},
edges AS (SELECT chrom, start, "end" FROM runs WHERE "end" - start >= 3 UNION ALL SELECT chrom, 0, 0 FROM contigs),
gaps AS (SELECT chrom, "end" AS start, coalesce(lead(start) OVER (PARTITION BY chrom ORDER BY start, "end"), (SELECT length FROM contigs c WHERE c.chrom = edges.chrom)) AS "end" FROM edges),
callable AS (SELECT * FROM gaps WHERE "end" > start)"""
CLUSTERS = f"""{VARIANTS_SQL},
steps AS (SELECT chrom, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) > 100 THEN 1 ELSE 0 END AS new FROM variants),
clusters AS (SELECT chrom, min(pos) AS first, max(pos) AS last, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY pos RANGE UNBOUNDED PRECEDING) AS c FROM steps) GROUP BY chrom, c),
dense AS (SELECT *, n / ("end" - start) AS density FROM (SELECT chrom, CAST(greatest(floor((first - 100) / 50) * 50, 0) AS BIGINT) AS start, CAST(floor((last + 100) / 50) * 50 AS BIGINT) AS "end", n FROM clusters))"""
SOLVED = f"{CALLS_SQL}, solved AS MATERIALIZED (SELECT DISTINCT chrom, pos FROM (SELECT * FROM golden INTERSECT SELECT * FROM called))"
MISSED = "(SELECT * FROM golden ANTI JOIN solved USING (chrom, pos))"
WRONG = "(SELECT * FROM called ANTI JOIN solved USING (chrom, pos))"
def applied(ploids: str) -> str:
    """Variants as they are applied ploid by ploid: one is refused if a base of it is on the list of bases taken so far."""
    return f"""{VARIANTS_SQL},
plain AS (SELECT DISTINCT chrom, pos, ref, alt FROM variants WHERE regexp_full_match(ref, '[ACGT]+')),
ranked AS MATERIALIZED (SELECT p.*, q.ploid, row_number() OVER (PARTITION BY chrom, ploid ORDER BY pos, CAST(length(ref) = length(alt) AS INT), ref, alt) AS rn FROM plain p JOIN (VALUES (0), (1)) q(ploid) ON {ploids}),
fold AS (SELECT *, TRUE AS ok, range(pos, pos + length(ref)) AS taken FROM ranked WHERE rn = 1
  UNION ALL SELECT r.*, NOT list_has_any(f.taken, range(r.pos, r.pos + length(r.ref))), CASE WHEN list_has_any(f.taken, range(r.pos, r.pos + length(r.ref))) THEN f.taken ELSE list_concat(f.taken, range(r.pos, r.pos + length(r.ref))) END
  FROM fold f JOIN ranked r ON r.chrom = f.chrom AND r.ploid = f.ploid AND r.rn = f.rn + 1),
kept AS (SELECT chrom, pos, ref, alt, ploid FROM fold WHERE ok)"""


EQUIVALENT = f"""{CALLS_SQL},
calls AS MATERIALIZED (SELECT * FROM called UNION ALL SELECT chrom, pos - 1, substr(seq, pos, 1) || ref, substr(seq, pos, 1) || alt FROM golden JOIN contigs USING (chrom) WHERE pos > 1 AND pos % 3 = 0),
solved AS MATERIALIZED (SELECT DISTINCT chrom, pos FROM (SELECT * FROM golden INTERSECT SELECT * FROM calls)),
missed AS MATERIALIZED (SELECT * FROM golden ANTI JOIN solved USING (chrom, pos)), wrong AS MATERIALIZED (SELECT * FROM calls ANTI JOIN solved USING (chrom, pos)),
near AS (SELECT w.*, v.pos AS vpos, v.ref AS vref, v.alt AS valt, side FROM wrong w JOIN (SELECT *, 'm' AS side FROM missed UNION ALL SELECT *, 'w' FROM wrong) v
  ON v.chrom = w.chrom AND v.pos < w.pos + 51 AND v.pos + length(v.ref) > w.pos - 50),
framed AS (SELECT n.*, greatest(n.pos - 100, 0) AS begin, substr(seq, greatest(n.pos - 100, 0) + 1, 201) AS around FROM near n JOIN contigs USING (chrom)),
placed AS (SELECT *, lag(vpos + length(vref), 1, begin) OVER (PARTITION BY side, chrom, pos, ref, alt ORDER BY vpos, vref, valt) AS before FROM framed),
local AS (SELECT side, chrom, pos, ref, alt, count(*) AS n, CASE WHEN bool_and(vpos >= before AND substr(around, vpos - begin + 1, length(vref)) = vref)
  THEN string_agg(substr(around, before - begin + 1, greatest(vpos - before, 0)) || valt, '' ORDER BY vpos, vref, valt) || substr(any_value(around), last(vpos + length(vref) - begin + 1 ORDER BY vpos, vref, valt)) END AS hap
  FROM placed GROUP BY side, chrom, pos, ref, alt)"""


HASHED = """h AS (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h, event_id % 50 AS k FROM events),
fq AS (SELECT CASE WHEN k = 1 THEN '>' ELSE '@' END || 'r' || event_id AS name,
  CASE k WHEN 2 THEN s || 'X' WHEN 3 THEN 'x' || substr(s, 2, 31) ELSE s END AS seq, CASE WHEN k = 4 THEN '-' ELSE '+' END AS plus,
  CASE k WHEN 5 THEN NULL WHEN 6 THEN substr(h, 1, 31) || 'z' ELSE translate(h, 'abcdef', 'ABCDEF') END AS qual
  FROM (SELECT *, translate(h, '0123456789abcdef', 'ACGTACGTACGTACGN') AS s FROM h))"""
WINDOWS = f"""{VARIANTS_SQL},
sized AS (SELECT chrom, length, greatest(length // 1000, 1) AS n FROM contigs),
win AS (SELECT chrom, win, win * (length // n) AS start, CASE WHEN win = n - 1 THEN length ELSE (win + 1) * (length // n) END AS core_end, length FROM (SELECT *, unnest(range(0, n)) AS win FROM sized)),
plan AS (SELECT chrom, win, start, core_end, least(core_end + 100, length) AS "end" FROM win)"""


def cases(u: str, values: list, weights: list[float]) -> str:
    """The value whose share holds u, as CASE from the top."""
    low = cumulative(weights)
    return "CASE " + " ".join(f"WHEN {u} >= CAST({c!r} AS DOUBLE) THEN {v}" for c, v in reversed(list(zip(low, values, strict=True)))) + " END"


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


#: What was written with a sink and read back with a source equals what was there before.
READS = """reads AS (SELECT 'r' || event_id AS name, event_id % 2 + 1 AS mate, event_id % 7 AS c, event_id * 13 % 5000 AS pos, translate(md5(CAST(event_id AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq,
  translate(md5('q' || event_id), '0123456789abcdef', 'ABCDEFGHIJABCDEF') AS qual, CASE WHEN event_id % 5 = 0 THEN '4S28M' WHEN event_id % 5 = 1 THEN '10M2I20M' ELSE '32M' END AS cigar FROM events)"""
ROUND_TRIPS = {
    "fasta_roundtrip": with_(CONTIGS_SQL, "SELECT 'c' || chrom AS chrom, md5(seq) AS digest, length FROM contigs"),
    "fasta_index_scan": with_(CONTIGS_SQL, "SELECT 'c' || chrom AS chrom, length, CAST(least(length, 60) AS BIGINT) AS line_bases, true AS uniform FROM contigs"),
    "fasta_trinuc_counts": with_(f"{CONTIGS_SQL}, {BASES}, t AS ({TRI_COUNTS})", f"SELECT tri, CAST(coalesce(n, 0) AS BIGINT) AS n FROM {TRI} LEFT JOIN t USING (tri)"),
    "fasta_gc_window_counts": with_(TILES, "SELECT CAST(gc AS INT) AS gc, count(*) AS n, round(sum(depth), 6) AS total FROM windows GROUP BY gc"),
    "fasta_regions": with_(INTERVALS_SQL, """SELECT 'c' || chrom AS chrom, start, substr(seq, start + 1, "end" - start) AS piece, count(*) AS n FROM (SELECT DISTINCT chrom, start, "end" FROM intervals) JOIN contigs USING (chrom) GROUP BY ALL"""),
    "fasta_names": with_(CONTIGS_SQL, "SELECT 'c' || chrom AS chrom FROM contigs"),
    "fasta_index_roundtrip": with_(CONTIGS_SQL, "SELECT 'c' || chrom AS chrom, length, 60 AS line_bases FROM contigs"),
    "vcf_roundtrip": with_(RECORDS, """SELECT 'c' || chrom AS chrom, pos, ref, alt, filter, 'DP=' || depth AS info, gt, count(*) AS n FROM records GROUP BY ALL"""),
    "tsv_variants_roundtrip": with_(VARIANTS_SQL, "SELECT 'c' || chrom AS chrom, pos, ref, alt, count(*) AS n FROM variants GROUP BY ALL"),
    "bed_roundtrip": with_(INTERVALS_SQL, """SELECT 'c' || chrom AS chrom, start, "end", 'mut_rate=0.' || (o_orderkey % 7) AS name FROM intervals"""),
    "rates_roundtrip": with_(INTERVALS_SQL, """SELECT 'c' || chrom AS chrom, start, "end", round(least(CAST('0.' || (o_orderkey % 7) AS DOUBLE), 0.3), 9) AS rate FROM intervals WHERE "end" - start > 1"""),
    "bed_track_lengths": with_(INTERVALS_SQL, """SELECT 'c' || chrom AS chrom, count(*) AS n, CAST(sum("end" - start + 1) AS BIGINT) AS track_len FROM intervals GROUP BY chrom"""),
    "mappable_roundtrip": with_(INTERVALS_SQL, """SELECT 'c' || chrom AS chrom, start, "end" FROM intervals WHERE o_orderkey % 100 >= 50"""),
    "depth_roundtrip": with_(INTERVALS_SQL, """SELECT 'c' || chrom AS chrom, start, start + 1 AS "end", CAST(o_orderkey % 50 AS DOUBLE) AS depth FROM intervals"""),
    "sam_roundtrip": f"WITH {READS} SELECT name, CAST(CASE mate WHEN 1 THEN 65 ELSE 129 END AS INT) AS flag, 'c' || c AS ref, pos, cigar, seq, qual FROM reads",
    "bam_roundtrip": f"WITH {READS} SELECT name, CAST(CASE mate WHEN 1 THEN 65 ELSE 129 END AS INT) AS flag, 'c' || c AS ref, pos, cigar, seq, qual FROM reads",
    "bam_ranges": f"WITH {READS} SELECT name, CAST(CASE mate WHEN 1 THEN 65 ELSE 129 END AS INT) AS flag, 'c' || c AS ref, pos, cigar, seq, qual, 60 AS mapq, 'c' || c AS mate_ref, pos + 50 AS mate_pos, 82 AS tlen FROM reads",
    "bam_faults": "SELECT CAST(0 AS BIGINT) AS at, 'not a BAM file' AS fault, count(DISTINCT 1) AS n FROM events HAVING count(*) > 0",
    "fastq_ranges": f"WITH {READS} SELECT '@' || name || '/' || mate AS name, seq, qual FROM reads",
    "fastq_blocks": f"WITH {READS} SELECT '@' || name || '/' || mate AS name, seq, qual FROM reads",
    "fastq_roundtrip": f"WITH {READS} SELECT '@' || name || '/' || mate AS name, seq, qual FROM reads",
    "aligned_qualities": f"""WITH {READS} SELECT name, CAST(CASE WHEN starts_with(cigar, '4S') THEN 28 ELSE 32 END AS INT) AS n, CAST(list_sum(list_transform(string_split(CASE WHEN starts_with(cigar, '4S') THEN substr(qual, 5) ELSE qual END, ''), lambda x: ascii(x) - 33)) AS BIGINT) AS total FROM reads""",
    "golden_vcf_roundtrip": with_(VARIANTS_SQL, "SELECT 'c' || chrom AS chrom, pos, ref, alt, '0.5' AS af FROM (SELECT DISTINCT chrom, pos, ref, alt FROM variants)"),
    "model_roundtrip": with_(QUALITIES_SQL, "SELECT CAST(pos AS INT) AS pos, CAST(q AS INT) AS q, count(*) AS n FROM q_long GROUP BY pos, q"),
    "trinuc_cache": with_(f"{CONTIGS_SQL}, {BASES}, t AS ({TRI_COUNTS})", f"SELECT tri, CAST(coalesce(n, 0) AS BIGINT) AS n FROM {TRI} LEFT JOIN t USING (tri)"),
    "callable_cache": with_(CALLABLE, 'SELECT chrom, start, "end" FROM callable'),
    "missed_vcf": with_(SOLVED, f"SELECT 'c' || chrom AS chrom, pos, ref, alt FROM {MISSED}"),
    "wrong_vcf": with_(SOLVED, f"SELECT 'c' || chrom AS chrom, pos, ref, alt FROM {WRONG}"),
}


def oracle_sql() -> dict[str, str]:
    first = "first_mates AS (SELECT abs(tlen) AS tlen FROM alignments WHERE (flag & 65) = 65 AND mapq > 10 AND (mate_ref = '=' OR mate_ref = ref))"
    limits = "m AS (SELECT median(tlen) AS median FROM first_mates), limits AS (SELECT any_value(m.median) AS median, median(abs(tlen - m.median)) AS mad FROM first_mates, m)"
    fraglen = lambda least: f"{ALIGNMENTS_SQL}, {first}, {limits}, c AS (SELECT tlen, count(*) AS n FROM first_mates GROUP BY tlen), k AS (SELECT tlen, n FROM c, limits WHERE tlen > 0 AND tlen <= median + 10 * mad AND n >= {least})"
    u = lambda what: uniform_sql(f"'{what}'", "event_id")
    return {
        "fraglen_model": with_(fraglen(100), "SELECT tlen, n, round(n / sum(n) OVER (), 9) AS p FROM k"),
        "tlen_median_mad": with_(f"{ALIGNMENTS_SQL}, {first.replace('abs(tlen)', 'tlen')}, {limits}", "SELECT * FROM limits"),
        "trinuc_ref_counts": with_(f"{CONTIGS_SQL}, {BASES}, t AS ({TRI_COUNTS})", f"SELECT tri, CAST(coalesce(n, 0) AS BIGINT) AS n FROM {TRI} LEFT JOIN t USING (tri)"),
        "gc_window_counts": with_(TILES, "SELECT CAST(gc AS INT) AS gc, count(*) AS n, round(sum(depth), 6) AS total FROM windows GROUP BY gc"),
        "gc_bias_model": with_(f"{TILES}, g AS (SELECT gc, count(*) AS n, sum(depth) AS total FROM windows GROUP BY gc), w AS (SELECT sum(total) / sum(n) AS overall FROM g)",
            "SELECT CAST(i AS INT) AS gc, coalesce(n, 0) AS n, round(coalesce(total / n, 0.0), 9) AS mean_depth, round(CASE WHEN overall > 0 THEN coalesce(total / n, 0.0) / overall ELSE 0.0 END, 9) AS scalar FROM range(51) r(i) LEFT JOIN g ON g.gc = i, w"),
        "n_islands": with_(RUNS, 'SELECT chrom, start, "end" FROM runs'),
        "callable_regions": with_(CALLABLE, 'SELECT chrom, start, "end" FROM callable'),
        "callable_bases": with_(CALLABLE, 'SELECT chrom, CAST(sum("end" - start) AS BIGINT) AS bases, count(*) AS n FROM callable GROUP BY chrom'),
        "contig_index": with_(CONTIGS_SQL, "SELECT chrom, length, length(replace(seq, 'N', '')) AS non_n, length(regexp_replace(seq, '[^GC]', '', 'g')) AS gc FROM contigs"),
        "reverse_complements": with_(CONTIGS_SQL, "SELECT chrom, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS rc FROM contigs"),
        "bam_bins": """WITH x AS (SELECT o_orderkey, o_orderkey * 1009 AS b, o_orderkey * 1009 + CAST(floor(o_totalprice) AS BIGINT) AS e FROM orders)
SELECT o_orderkey, CAST(CASE WHEN b >> 14 = e >> 14 THEN 4681 + (b >> 14) WHEN b >> 17 = e >> 17 THEN 585 + (b >> 17) WHEN b >> 20 = e >> 20 THEN 73 + (b >> 20)
  WHEN b >> 23 = e >> 23 THEN 9 + (b >> 23) WHEN b >> 26 = e >> 26 THEN 1 + (b >> 26) ELSE 0 END AS BIGINT) AS bin FROM x""",
        "sam_flags": """SELECT CAST(1 + CASE WHEN l_linenumber % 2 = 0 THEN 64 ELSE 128 END + CASE WHEN l_suppkey % 2 = 0 THEN 16 ELSE 32 END + CASE WHEN l_partkey % 3 = 0 THEN 4 ELSE 2 END AS INT) AS flag, count(*) AS n FROM lineitem GROUP BY ALL""",
        "cigar_roundtrip": """SELECT DISTINCT l_partkey, c AS cigar, CAST((l_partkey % 20 + 1) + (l_partkey % 3 + 1) + (l_partkey % 7 + 1) + (l_partkey % 11 + 1) AS INT) AS bases, c AS again FROM (
  SELECT l_partkey, (l_partkey % 20 + 1) || 'M' || (l_partkey % 3 + 1) || 'I' || (l_partkey % 7 + 1) || 'M' || (l_partkey % 4 + 1) || 'D' || (l_partkey % 11 + 1) || 'M' AS c FROM lineitem)""",
        "phred_error_rate": with_(QUALITIES_SQL, "SELECT CAST(pos AS INT) AS pos, round(avg(pow(10.0, -q / 10.0)), 9) AS mean_error, CAST(floor(-10.0 * log10(avg(pow(10.0, -q / 10.0))) + 0.5) AS INT) AS q FROM q_long GROUP BY pos"),
        "quality_strings": with_(QUALITIES_SQL, "SELECT read_id, string_agg(chr(CAST(q + 33 AS INT)), '' ORDER BY pos) AS qual, string_agg(CASE WHEN q <= 10 THEN 'N' ELSE substr('ACGTACGTACGTACGT', CAST(pos + 1 AS INT), 1) END, '' ORDER BY pos) AS seq FROM q_long GROUP BY read_id"),
        "variant_validity": with_(f"""{VARIANTS_SQL},
x AS (SELECT v.ref AS there, CASE WHEN l_partkey % 13 = 0 THEN translate(ref, 'ACGT', 'CGTA') ELSE ref END AS ref, CASE WHEN l_partkey % 17 = 0 THEN '<DEL>' ELSE alt END AS alt FROM variants v)""",
            "SELECT CASE WHEN there <> ref THEN 'ref_mismatch' WHEN contains(ref, 'N') THEN 'n_in_ref' WHEN NOT regexp_full_match(alt, '[ACGT]+') THEN 'bad_alt' ELSE 'ok' END AS reason, count(*) AS n FROM x GROUP BY ALL"),
        "skip_counters": with_(f"""{RECORDS},
r AS MATERIALIZED (SELECT r.* EXCLUDE (ref), ref AS there, CASE WHEN l_partkey % 13 = 0 THEN translate(ref, 'ACGT', 'CGTA') ELSE ref END AS ref FROM records r),
s AS MATERIALIZED (SELECT *, CASE WHEN alt = ref THEN 'no_variant' WHEN filter NOT IN ('PASS', '.') THEN 'filtered' WHEN pos <= 0 THEN 'no_position' WHEN NOT (g1 = 1 OR g2 = 1) THEN 'not_carried' ELSE 'kept' END AS reason FROM r),
a AS (SELECT s.* EXCLUDE (alt, reason), unnest(string_split(alt, ',')) AS alt FROM s WHERE reason = 'kept'),
v AS MATERIALIZED (SELECT chrom, pos, CASE WHEN there <> ref THEN 'ref_mismatch' WHEN contains(ref, 'N') THEN 'n_in_ref' WHEN NOT regexp_full_match(alt, '[ACGT]+') THEN 'bad_alt' ELSE 'valid' END AS reason FROM a),
p AS (SELECT count(*) AS valid, count(DISTINCT (chrom, pos)) AS positions FROM v WHERE reason = 'valid'),
found AS (SELECT reason, count(*) AS n FROM s GROUP BY reason UNION ALL SELECT reason, count(*) FROM v GROUP BY reason UNION ALL SELECT 'positions', positions FROM p UNION ALL SELECT 'duplicate', valid - positions FROM p)""",
            "SELECT reason, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(['no_variant', 'filtered', 'no_position', 'not_carried', 'kept', 'valid', 'ref_mismatch', 'n_in_ref', 'bad_alt', 'positions', 'duplicate']) AS reason) LEFT JOIN found USING (reason)"),
        "variant_filters": with_(RECORDS, "SELECT filter, gt, count(*) AS n FROM records WHERE alt <> ref AND filter IN ('PASS', '.') AND pos > 0 AND (g1 = 1 OR g2 = 1) GROUP BY ALL"),
        "variant_trim_suffix": with_(f"""RECURSIVE {VARIANTS_SQL},
kinds AS (SELECT ref || 'GT' AS ref, alt || 'GT' AS alt, count(*) AS n FROM variants GROUP BY ALL),
cut AS (SELECT ref, alt, n FROM kinds UNION ALL SELECT left(ref, length(ref) - 1), left(alt, length(alt) - 1), n FROM cut WHERE length(ref) > 1 AND length(alt) > 1 AND right(ref, 1) = right(alt, 1))""",
            "SELECT ref, alt, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE NOT (length(ref) > 1 AND length(alt) > 1 AND right(ref, 1) = right(alt, 1)) GROUP BY ALL"),
        "variant_dedup_first": with_(VARIANTS_SQL, """SELECT chrom, pos, ref, alt, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM variants
QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, ref, alt) = 1"""),
        "variant_trim_pad": with_(LEARNED, "SELECT ref, alt, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos FROM learned GROUP BY ALL"),
        "multiallelic_split": with_(RECORDS, """SELECT chrom, pos, ref, a AS alt, CAST(i - 1 AS INT) AS alt_no, CAST(af AS DOUBLE) AS af, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (
  SELECT *, unnest(string_split(alt, ',')) AS a, unnest(range(1, len(string_split(alt, ',')) + 1)) AS i FROM records)"""),
        "info_fields": with_(RECORDS, "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(depth AS INT) AS depth, freq, af FROM records"),
        "genotype_extract": with_(RECORDS, "SELECT gt, g1 || '/' || g2 AS wp, CAST(g1 + g2 AS INT) AS n_ploids, count(*) AS n FROM records GROUP BY ALL"),
        "merged_alleles": with_(VARIANTS_SQL + ", n AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS rn FROM variants)",
            "SELECT chrom, pos, ref, string_agg(alt, ',' ORDER BY rn DESC) AS alt FROM (SELECT chrom, pos, ref, alt, max(rn) AS rn FROM n GROUP BY ALL) GROUP BY chrom, pos, ref"),
        "mutation_spectrum": with_(f"""{CONTEXTS}, c AS (SELECT tri_ref, tri_alt, count(*) AS n FROM contexts GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY tri_ref) AS p FROM c),
every AS (SELECT tri AS tri_ref, left(tri, 1) || b || right(tri, 1) AS tri_alt FROM {TRI}, bases WHERE b <> substr(tri, 2, 1))""",
            "SELECT tri_ref, tri_alt, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(p, 0.0), 9) AS p FROM every LEFT JOIN p USING (tri_ref, tri_alt)"),
        "trinuc_mut_prob": with_(f"{CONTEXTS}, t AS ({TRI_COUNTS}), m AS (SELECT tri_ref AS tri, count(*) AS n_mut FROM contexts GROUP BY tri_ref)",
            f"SELECT tri, coalesce(n, 0) AS n_ref, coalesce(n_mut, 0) AS n_mut, round(CASE WHEN coalesce(n, 0) > 0 THEN coalesce(n_mut, 0) / n ELSE 0.0 END, 12) AS p FROM {TRI} LEFT JOIN t USING (tri) LEFT JOIN m USING (tri)"),
        "base_transitions": with_(CONTEXTS, "SELECT ref, alt, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY ref), 9) AS p FROM contexts GROUP BY ref, alt"),
        "indel_freq": with_(LEARNED, "SELECT CAST(CASE WHEN ref = '-' THEN length(alt) ELSE -length(ref) END AS INT) AS size, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS p FROM learned WHERE ref = '-' OR alt = '-' GROUP BY 1"),
        "avg_mut_rate": with_(LEARNED, """SELECT count(*) FILTER (ref <> '-' AND alt <> '-') AS n_snp, count(*) FILTER (ref = '-' OR alt = '-') AS n_indel,
  round(count(*) FILTER (ref <> '-' AND alt <> '-') / count(*), 9) AS snp_share, round(count(*) / (SELECT sum(length(replace(seq, 'N', ''))) FROM contigs), 12) AS rate FROM learned"""),
        "restricted_variants": with_(f"{LEARNED}, {INTERVALS_SQL[len(CONTIGS_SQL) + 2:]}",
            'SELECT chrom, count(*) AS n FROM learned l WHERE EXISTS (SELECT 1 FROM intervals i WHERE i.chrom = l.chrom AND i.start <= l.pos AND l.pos < i."end") GROUP BY chrom'),
        "common_variants": with_(RECORDS, "SELECT freq, count(*) AS n FROM records WHERE freq >= (SELECT quantile_cont(freq, 0.95) FROM records) GROUP BY freq"),
        "gap_clusters": with_(CLUSTERS, "SELECT * FROM clusters"),
        "high_mut_regions": with_(CLUSTERS, 'SELECT chrom, start, "end", n, round(density, 9) AS density FROM dense WHERE density >= (SELECT quantile_cont(density, 0.97) FROM dense)'),
        # folded from the last region back: one that reaches the one after it takes its end and the mean of both rates
        "merged_high_regions": with_(f"""RECURSIVE {CLUSTERS},
top AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start DESC, "end" DESC, density DESC) AS rn FROM dense WHERE density >= (SELECT quantile_cont(density, 0.5) FROM dense)),
fold AS (SELECT chrom, rn, start, "end", density, 1 AS piece FROM top WHERE rn = 1 UNION ALL
  SELECT t.chrom, t.rn, t.start, CASE WHEN t."end" >= f.start THEN f."end" ELSE t."end" END, CASE WHEN t."end" >= f.start THEN (t.density + f.density) / 2 ELSE t.density END, CASE WHEN t."end" >= f.start THEN f.piece ELSE f.piece + 1 END
  FROM fold f JOIN top t ON t.chrom = f.chrom AND t.rn = f.rn + 1),
done AS (SELECT chrom, piece, arg_max(start, rn) AS start, arg_max("end", rn) AS "end", arg_max(density, rn) AS rate FROM fold GROUP BY chrom, piece)""",
            'SELECT chrom, count(*) AS n, CAST(sum("end" - start) AS BIGINT) AS bases, round(sum(rate), 6) AS rates FROM done GROUP BY chrom'),
        "trinuc_contig_counts": with_(f"{CONTIGS_SQL}, {BASES}, t AS (SELECT chrom, substr(seq, i, 3) AS tri, count(*) AS n FROM (SELECT chrom, seq, unnest(range(1, length - 1)) AS i FROM contigs) GROUP BY ALL)",
            f"SELECT chrom, tri, CAST(coalesce(n, 0) AS BIGINT) AS n FROM contigs CROSS JOIN {TRI} LEFT JOIN t USING (chrom, tri)"),
        "trinuc_region_counts": with_(f"""{INTERVALS_SQL}, {BASES}, t AS (SELECT substr(seq, CAST(i AS BIGINT), 3) AS tri, count(*) AS n FROM (SELECT seq, unnest(range(start + 1, "end" - 1)) AS i FROM intervals JOIN contigs USING (chrom)) GROUP BY ALL)""",
            f"SELECT tri, CAST(coalesce(n, 0) AS BIGINT) AS n FROM {TRI} LEFT JOIN t USING (tri)"),
        "random_genotypes": f"SELECT event_id, CASE WHEN floor({uniform_sql(chr(39) + 'het' + chr(39), 'event_id')} * 2) = 0 THEN '1/0' ELSE '0/1' END AS gt FROM events",
        "sample_genotypes": with_(RECORDS, "SELECT gt AS genotype, CAST(l_suppkey AS INT) AS depth, count(*) AS n FROM records GROUP BY ALL"),
        "targets_by_length": with_(f"{VARIANTS_SQL}, {INTERVALS_SQL[len(CONTIGS_SQL) + 2:]}",
            'SELECT chrom, count(*) AS n FROM variants v WHERE EXISTS (SELECT 1 FROM intervals i WHERE i.chrom = v.chrom AND i."end" - i.start >= 60 AND i.start <= v.pos AND v.pos < i."end") GROUP BY chrom'),
        "quality_range": with_(QUALITIES_SQL, "SELECT CAST(min(q) AS INT) AS least, CAST(max(q) AS INT) AS most, count(*) FILTER (q > 30) AS n_outside FROM q_long"),
        "first_reads": with_(QUALITIES_SQL, "SELECT read_id, CAST(sum(q) AS BIGINT) AS total FROM q_long WHERE read_id IN (SELECT event_id FROM events ORDER BY event_id LIMIT 500) GROUP BY read_id"),
        "moving_mean_depth": with_(f"""{INTERVALS_SQL}, b AS (SELECT chrom, start, count(*) AS n FROM intervals GROUP BY ALL)""",
            "SELECT chrom, start, round((SELECT sum(n) FROM b y WHERE y.chrom = x.chrom AND y.start >= x.start AND y.start < x.start + 100) / 100.0, 9) AS mean FROM b x"),
        **ROUND_TRIPS,
        "merge_intervals": with_(INTERVALS_SQL, MERGED.format(source="intervals")),
        "points_in_intervals": with_(f"{VARIANTS_SQL}, {INTERVALS_SQL[len(CONTIGS_SQL) + 2:]}", 'SELECT o_orderkey, count(*) AS n FROM variants v JOIN intervals i ON v.chrom = i.chrom AND v.pos >= i.start AND v.pos < i."end" GROUP BY o_orderkey'),
        "points_strictly_inside": with_(f"{VARIANTS_SQL}, {INTERVALS_SQL[len(CONTIGS_SQL) + 2:]}", 'SELECT o_orderkey, count(*) AS n FROM variants v JOIN intervals i ON v.chrom = i.chrom AND v.pos > i.start AND v.pos < i."end" GROUP BY o_orderkey'),
        "coverage_levels": with_(f"""{INTERVALS_SQL},
placed AS (SELECT chrom, row_number() OVER (PARTITION BY chrom ORDER BY start, o_orderkey) - 1 AS place, CAST("end" - start AS DOUBLE) AS x, sum("end" - start) OVER (PARTITION BY chrom) AS total FROM intervals),
known AS (SELECT *, min(x) OVER (PARTITION BY chrom) AS low, max(x) OVER (PARTITION BY chrom) AS high FROM placed WHERE x >= 1e-12 * total),
level AS (SELECT chrom, place, list_max(list_filter(list_transform(range(10), lambda i: low + (i / 10.0::DOUBLE) * (high - low)), lambda e: e <= x)) AS level FROM known),
marked AS (SELECT *, CASE WHEN lag(place) OVER w = place - 1 AND lag(level) OVER w = level THEN 0 ELSE 1 END AS new FROM level WINDOW w AS (PARTITION BY chrom ORDER BY place)),
run AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY place) AS run FROM marked)""", "SELECT chrom, min(place) AS first, max(place) AS last, round(max(level), 6) AS level FROM run GROUP BY chrom, run"),
        "gc_profile": with_(f"""{CONTIGS_SQL},
w AS (SELECT chrom, seq, length, unnest(range(0, length, 100)) AS start FROM contigs)""", """SELECT chrom, start, least(start + 100, length) AS "end", length(regexp_replace(CASE WHEN start + 100 < length THEN substr(seq, start + 1, 100) ELSE right(seq, 100) END, '[^GC]', '', 'g')) AS gc FROM w"""),
        "interval_overlap_bp": with_(INTERVALS_SQL, """SELECT a.chrom, count(*) AS n, CAST(sum(least(a."end", b."end") - greatest(a.start, b.start)) AS BIGINT) AS bases
FROM intervals a JOIN intervals b ON a.chrom = b.chrom AND a.o_orderkey % 2 = 0 AND b.o_orderkey % 2 = 1 AND a.start < b."end" AND b.start < a."end" GROUP BY a.chrom"""),
        "model_jaccard": with_(f"""{CALLS_SQL}, {INTERVALS_SQL[len(CONTIGS_SQL) + 2:]},
ra AS ({MERGED.format(source="(SELECT * FROM intervals WHERE o_orderkey % 3 > 0)")}), rb AS ({MERGED.format(source="(SELECT * FROM intervals WHERE o_orderkey % 3 < 2)")}),
s AS (SELECT CAST(coalesce(sum(least(ra."end", rb."end") - greatest(ra.start, rb.start)), 0) AS BIGINT) AS bp FROM ra JOIN rb ON ra.chrom = rb.chrom AND ra.start < rb."end" AND rb.start < ra."end"),
z AS (SELECT (SELECT sum("end" - start) FROM ra) AS a, (SELECT sum("end" - start) FROM rb) AS b, (SELECT count(*) FROM golden) AS na, (SELECT count(*) FROM called) AS nb, (SELECT count(*) FROM (SELECT * FROM golden INTERSECT SELECT * FROM called)) AS nab)""",
            "SELECT 'a' AS model_a, 'b' AS model_b, bp AS shared_bp, nab AS shared_variants, round(bp / (a + b - bp), 9) AS region_jaccard, round(nab / (na + nb - nab), 9) AS variant_jaccard FROM s, z"),
        "discard_offtarget": with_(f"""{VARIANTS_SQL}, {INTERVALS_SQL[len(CONTIGS_SQL) + 2:]}, r AS (SELECT DISTINCT chrom, pos FROM variants)""",
            'SELECT chrom, count(*) AS n FROM r WHERE EXISTS (SELECT 1 FROM intervals i WHERE i.chrom = r.chrom AND (i.start <= r.pos AND r.pos < i."end" OR i.start <= r.pos + 30 AND r.pos + 30 < i."end")) GROUP BY chrom'),
        "vcf_compare_summary": with_(SOLVED, f"""SELECT n_golden, n_called, n_perfect, n_missed, n_wrong, round(100.0 * n_missed / n_golden, 6) AS missed_pct, round(100.0 * n_wrong / n_called, 6) AS wrong_pct FROM (SELECT
  (SELECT count(*) FROM golden) AS n_golden, (SELECT count(*) FROM called) AS n_called, (SELECT count(*) FROM solved) AS n_perfect,
  (SELECT count(*) FROM {MISSED}) AS n_missed, (SELECT count(*) FROM {WRONG}) AS n_wrong)"""),
        "vcf_fn": with_(SOLVED, f"SELECT * FROM {MISSED}"),
        "vcf_fp": with_(SOLVED, f"SELECT * FROM {WRONG}"),
        "vcf_equivalent": with_(EQUIVALENT, "SELECT m.chrom, m.pos, m.ref, m.alt, m.n AS n_missed FROM local m JOIN local w USING (chrom, pos, ref, alt) WHERE m.side = 'm' AND w.side = 'w' AND m.hap = w.hap"),
        "fn_attribution": with_(f"""{SOLVED}, {INTERVALS_SQL[len(CONTIGS_SQL) + 2:]},
f AS (SELECT EXISTS (SELECT 1 FROM intervals i WHERE i.chrom = m.chrom AND o_orderkey % 4 = 0 AND i.start <= m.pos AND m.pos < i."end") AS unmappable,
  CAST((SELECT sum(o_orderkey % 5 + 1) FROM intervals i WHERE i.chrom = m.chrom AND i.start <= m.pos AND m.pos < i."end") AS BIGINT) AS depth FROM {MISSED} m)""",
            "SELECT unmappable, coalesce(depth < 3, FALSE) AS low_depth, NOT unmappable AND coalesce(depth >= 3, TRUE) AS unknown, count(*) AS n, CAST(sum(depth) AS BIGINT) AS total_depth FROM f GROUP BY ALL"),
        "af_classes": with_(VARIANTS_SQL, "SELECT CAST(least(greatest(floor((l_discount * 10 - 0.05) * 20), 0), 20) AS INT) AS af_class, count(*) AS n FROM variants GROUP BY 1"),
        "quality_marginals": with_(QUALITIES_SQL, "SELECT CAST(pos AS INT) AS pos, CAST(q AS INT) AS q, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY pos), 9) AS p FROM q_long GROUP BY pos, q"),
        "quality_transitions": with_(QUALITIES_SQL + ", t AS (SELECT pos, lag(q) OVER (PARTITION BY read_id ORDER BY pos) AS q_prev, q FROM q_long)",
            "SELECT CAST(pos AS INT) AS pos, CAST(q_prev AS INT) AS q_prev, CAST(q AS INT) AS q, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY pos, q_prev), 9) AS p FROM t WHERE q_prev IS NOT NULL GROUP BY pos, q_prev, q"),
        # a chain learned from all reads has their marginals, so its mean error is that of the qualities themselves
        "mean_error_exact": with_(QUALITIES_SQL, "SELECT round(avg(e), 6) AS mean_error FROM (SELECT pos, avg(pow(10.0, -q / 10.0)) AS e FROM q_long GROUP BY pos)"),
        "weighted_median": """SELECT CAST(CASE WHEN a >= t / 2 THEN 0 WHEN a + b >= t / 2 THEN 1 WHEN a + b + c >= t / 2 THEN 2 ELSE 3 END AS INT) AS index, count(*) AS n
FROM (SELECT l_quantity AS a, l_tax AS b, l_extendedprice AS c, l_quantity + l_tax + l_extendedprice + l_linenumber AS t FROM lineitem) GROUP BY 1""",
        "discrete_draw": f"SELECT event_id, {cases(u('draw'), [10, 20, 30], [0.25, 0.25, 0.5])} AS value FROM events",
        "poisson_draw": f"SELECT {cases(u('poisson'), list(range(21)), poisson_weights(2.0, 20))} AS k, count(*) AS n FROM events GROUP BY 1",
        "fragment_draw": f"SELECT {cases(u('fragment'), *normal_lengths(300, 10))} AS size, count(*) AS n FROM events GROUP BY 1",
        "random_sequences": f"SELECT event_id, string_agg(substr('ACGT', CAST(floor({uniform_sql(chr(39) + 'dna' + chr(39), 'event_id', 'i')} * 4) AS INT) + 1, 1), '' ORDER BY i) AS seq FROM events, range(12) r(i) GROUP BY event_id",
        "fragment_knots": with_(f"""{fraglen(10)}, p AS (SELECT tlen, n / sum(n) OVER () AS p FROM k),
steps AS (SELECT tlen, floor((sum(p) OVER (ORDER BY tlen) + 1e-12) / 0.1) AS level FROM p), knots AS (SELECT DISTINCT min(tlen) AS knot FROM steps WHERE level > 0 GROUP BY level)""",
            "SELECT tlen, CAST(arg_min(knot, abs(tlen - knot) * 100000 + knot) AS INT) AS knot FROM k, knots GROUP BY tlen"),
        "window_plan": with_(WINDOWS, "SELECT * FROM plan"),
        "variant_windows": with_(WINDOWS, 'SELECT v.chrom, win, count(*) AS n FROM variants v JOIN plan p ON v.chrom = p.chrom AND v.pos >= p.start AND v.pos < p."end" GROUP BY v.chrom, win'),
        "coverage_moving_sum": with_(INTERVALS_SQL, """SELECT chrom, o_orderkey, CAST(sum(b) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS BIGINT) AS ahead, CAST(sum(b) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS before,
  coalesce(lag(b, 2) OVER w, 0) AS shifted FROM (SELECT *, "end" - start AS b FROM intervals) WINDOW w AS (PARTITION BY chrom ORDER BY start, o_orderkey)"""),
        "conflict_free": with_("RECURSIVE " + applied("pos % 3 = 0 OR ploid = pos % 2"), "SELECT chrom, pos, ref, alt, string_agg(CAST(ploid AS VARCHAR), '/' ORDER BY ploid) AS ploids FROM kept GROUP BY ALL"),
        "haplotypes": with_(f"""RECURSIVE {applied("ploid = 0")}, {WINDOWS[len(VARIANTS_SQL) + 2:]},
inside AS (SELECT p.chrom, win, start, pos, ref, alt, pos + length(ref) AS upto FROM plan p JOIN kept k ON k.chrom = p.chrom AND pos >= start AND pos + length(ref) <= core_end),
parts AS (SELECT i.chrom, win, pos, upto, substr(seq, coalesce(lag(upto) OVER w, start) + 1, pos - coalesce(lag(upto) OVER w, start)) || alt AS part FROM inside i JOIN contigs USING (chrom) WINDOW w AS (PARTITION BY i.chrom, win ORDER BY pos)),
put AS (SELECT chrom, win, string_agg(part, '' ORDER BY pos) AS text, max(upto) AS upto, count(*) AS n FROM parts GROUP BY ALL)""",
            "SELECT p.chrom, p.win, md5(coalesce(text, '') || substr(seq, coalesce(upto, start) + 1, core_end - coalesce(upto, start))) AS digest, CAST(coalesce(n, 0) AS INT) AS n FROM plan p JOIN contigs USING (chrom) LEFT JOIN put USING (chrom, win)"),
        "golden_tally": with_(RECORDS, """SELECT chrom, pos, ref, alt, (max(g1) + max(g2)) / 2 AS af, 'WP=' || max(g1) || '/' || max(g2) AS info FROM records WHERE g1 = 1 OR g2 = 1 GROUP BY chrom, pos, ref, alt"""),
        "fastq_validate": with_(HASHED, """SELECT CASE WHEN qual IS NULL THEN 'missing_line' WHEN left(name, 1) <> '@' THEN 'bad_header' WHEN left(plus, 1) <> '+' THEN 'bad_separator' WHEN length(seq) <> length(qual) THEN 'length_mismatch'
  WHEN NOT regexp_full_match(seq, '[ACGTN]*') THEN 'bad_base' WHEN NOT regexp_full_match(qual, '[!-J]*') THEN 'bad_quality' ELSE 'ok' END AS error, count(*) AS n FROM fq GROUP BY 1"""),
        "mate_validate": """SELECT CASE WHEN event_id % 31 = 0 OR event_id % 37 = 0 THEN 'unpaired' ELSE 'name_mismatch' END AS error, count(*) AS n FROM events
WHERE (event_id % 31 = 0) <> (event_id % 37 = 0) OR (event_id % 31 > 0 AND event_id % 37 > 0 AND event_id % 41 = 0) GROUP BY 1""",
        "population_cull": f"""WITH n AS (SELECT count(*) AS n FROM customer), d AS (SELECT 1 AS generation, unnest(range(0, 2 * n)) AS member_id FROM n),
k AS (SELECT *, member_id // 2 AS parent_id, row_number() OVER (ORDER BY {uniform_sql("'cull'", "9", "1", "member_id")} DESC, member_id) AS r FROM d)
SELECT generation, member_id, parent_id FROM k, n WHERE r <= 2 * n - round_even(2 * n * 0.25, 0)""",
        "event_tumbling": "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
        "event_sessions": """WITH s AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 1800000000 THEN 1 ELSE 0 END AS new FROM events)
SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS c FROM s) GROUP BY user_id, c""",
        "substitution_heatmaps": with_(CONTEXTS, "SELECT left(tri_ref, 1) || '_' || right(tri_ref, 1) AS flanks, ref, count(*) FILTER (alt = 'A') AS n_A, count(*) FILTER (alt = 'C') AS n_C, count(*) FILTER (alt = 'G') AS n_G, count(*) FILTER (alt = 'T') AS n_T FROM contexts GROUP BY ALL"),
        "fn_depth_histogram": with_(f"""{SOLVED}, {INTERVALS_SQL[len(CONTIGS_SQL) + 2:]},
f AS (SELECT CAST((SELECT sum(o_orderkey % 5 + 1) FROM intervals i WHERE i.chrom = m.chrom AND i.start <= m.pos AND m.pos < i."end") AS BIGINT) AS depth FROM {MISSED} m)""",
            "SELECT depth, count(*) AS n FROM f GROUP BY depth"),
        "human_contigs": with_(CONTIGS_SQL, "SELECT CASE WHEN chrom % 2 = 0 THEN 'chr' ELSE '' END || (chrom % 40) AS chrom, CAST(sum(length) AS BIGINT) AS bases FROM contigs WHERE chrom % 40 BETWEEN 1 AND 29 GROUP BY 1"),
        "balanced_parts": with_(CONTIGS_SQL, "SELECT chrom, least(CAST(floor((sum(length) OVER (ORDER BY chrom) - length) * 7 / (SELECT sum(length) FROM contigs)) AS BIGINT), 6) AS part FROM contigs"),
        "conforming_reads": "SELECT event_id AS read_id FROM events WHERE event_id % 3 = 1",
        "phred_bins": "SELECT round(pow(10.0, -(event_id % 41) / 10.0), 9) AS p, CAST(event_id % 41 AS INT) AS q, count(*) AS n FROM events GROUP BY 1, 2",
    }
