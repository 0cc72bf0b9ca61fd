"""Genomic inputs derived from the driver's tables, and the same in SQL for the oracles.

Texts become contigs (letters mapped to ACGT, v and w to N), line items become variant
records and alignments, orders become intervals. Positions are 0-based.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.random import uniform
from strandloom.operators.chunks import bases_at

LETTERS, AS_BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTANNTAC"
#: Letters of the shortest text that can hold a variant.
LEAST_CONTIG = 4
#: Most texts whose lengths are sent to all tasks (16 bytes each); the lengths of more are dealt out with what they meet.
SENT_LENGTHS = 1 << 20
#: Bases of a block, a multiple of three.
BLOCK = 3072


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, seq, length of every text with LEAST_CONTIG letters or more.

    The explode of one value has Spark work out the sequence once a text; else generated
    code does it again for every row that a join finds for the text.
    """
    letters = F.lower(F.regexp_replace("text", "[^A-Za-z]+", ""))
    seqs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chrom"), F.explode(F.array(F.translate(letters, LETTERS, AS_BASES))).alias("seq"))
    return seqs.withColumn("length", F.char_length("seq").cast("long")).where(F.col("length") >= LEAST_CONTIG)


def contig_number(spark: SparkSession, sf_dir: str, key: Column) -> Column:
    return F.pmod(key, F.lit(n_documents(spark, sf_dir)))


def n_documents(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n")).first()[0]


def variants(spark: SparkSession, sf_dir: str, front: bool = False) -> DataFrame:
    """Variant records on the contigs: an SNP or a padded indel for each line item on a contig; with ``front``, the base ahead of each."""
    seqs = contigs(spark, sf_dir)
    n, lengths = n_documents(spark, sf_dir), seqs.select("chrom", "length")
    items = table(spark, sf_dir, "lineitem").withColumn("chrom", F.pmod("l_orderkey", F.lit(n)))
    at = (F.col("l_partkey") * 31 + F.col("l_suppkey") * 17 + F.col("l_linenumber") * 7 + F.col("l_orderkey") * 13) % (F.col("length") - 3) + 1
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    used = ["chrom", "pos", "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_extendedprice", *keys]
    # only short pieces of the sequences are joined with the many items
    placed = items.join(F.broadcast(lengths) if n <= SENT_LENGTHS else lengths, "chrom").withColumn("pos", at).select(used)
    placed = bases_at(placed, seqs, before=int(front), length=4 + front, size=256)
    size = F.when(F.col("l_linenumber") % 4 == 0, (F.col("l_suppkey") % 3 + 2).cast("int")).otherwise(F.lit(1))
    ref = F.substring("around", F.lit(1 + front), size)
    kind = F.col("l_linenumber") % 4
    base = F.left(F.col("ref"), F.lit(1))
    alt = (
        F.when(kind == 0, base)
        .when(kind == 1, F.concat(F.col("ref"), F.substring(F.lit("ACGTACGT"), (F.col("l_partkey") % 4 + 1).cast("int"), (F.col("l_suppkey") % 3 + 1).cast("int"))))
        .when(kind == 2, F.translate("ref", "ACGTN", "GTACA"))
        .otherwise(F.translate("ref", "ACGTN", "CATGA"))
    )
    ahead = [F.left("around", F.lit(1)).alias("front")] if front else []
    return placed.select("chrom", "pos", ref.alias("ref"), *used[2:], *ahead).withColumn("alt", alt)


CONTIGS_SQL = f"""
contigs AS MATERIALIZED (SELECT chrom, seq, CAST(length(seq) AS BIGINT) AS length FROM (
  SELECT doc_id AS chrom, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{AS_BASES}') AS seq FROM documents)
  WHERE length(seq) >= {LEAST_CONTIG})"""
VARIANTS_SQL = f"""{CONTIGS_SQL},
with_ref AS MATERIALIZED (SELECT *, substr(seq, pos + 1, CASE WHEN l_linenumber % 4 = 0 THEN l_suppkey % 3 + 2 ELSE 1 END) AS ref FROM (
  SELECT l.*, c.chrom, c.seq, (l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7 + l_orderkey * 13) % (c.length - 3) + 1 AS pos
  FROM lineitem l JOIN contigs c ON c.chrom = l.l_orderkey % (SELECT count(*) FROM documents))),
variants AS MATERIALIZED (SELECT * EXCLUDE (seq), CASE l_linenumber % 4 WHEN 0 THEN left(ref, 1)
  WHEN 1 THEN ref || substr('ACGTACGT', l_partkey % 4 + 1, l_suppkey % 3 + 1)
  WHEN 2 THEN translate(ref, 'ACGTN', 'GTACA') ELSE translate(ref, 'ACGTN', 'CATGA') END AS alt FROM with_ref)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, start, end, o_orderkey: a stretch of 20 to 99 bases for each order on a contig."""
    placed = table(spark, sf_dir, "orders").withColumn("chrom", contig_number(spark, sf_dir, F.col("o_custkey"))).join(contigs(spark, sf_dir).drop("seq"), "chrom")
    start = F.col("o_orderkey") * 17 % F.col("length")
    return placed.withColumn("start", start).select("chrom", "start", F.least("length", F.col("start") + 20 + F.col("o_orderkey") % 80).alias("end"), "o_orderkey", "o_totalprice")


INTERVALS_SQL = f"""{CONTIGS_SQL},
intervals AS MATERIALIZED (SELECT chrom, start, least(length, start + 20 + o_orderkey % 80) AS "end", o_orderkey, o_totalprice FROM (
  SELECT c.chrom, c.length, o_orderkey * 17 % c.length AS start, o_orderkey, o_totalprice
  FROM orders JOIN contigs c ON c.chrom = o_custkey % (SELECT count(*) FROM documents)))"""


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flag, mapq, mate_ref, ref, tlen of a read for each line item; some lengths are far out."""
    far = F.when(F.col("l_partkey") % 97 == 0, 5000).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") % 2 == 1, 99).otherwise(147).alias("flag"),
        (F.col("l_partkey") % 40).alias("mapq"),
        F.when(F.col("l_orderkey") % 11 == 0, "chrX").otherwise("=").alias("mate_ref"),
        F.lit("chr1").alias("ref"),
        (F.floor("l_quantity") + 200 + far).cast("long").alias("tlen"),
    )


ALIGNMENTS_SQL = """
alignments AS (SELECT CASE WHEN l_linenumber % 2 = 1 THEN 99 ELSE 147 END AS flag, l_partkey % 40 AS mapq,
  CASE WHEN l_orderkey % 11 = 0 THEN 'chrX' ELSE '=' END AS mate_ref, 'chr1' AS ref,
  CAST(floor(l_quantity) AS BIGINT) + 200 + CASE WHEN l_partkey % 97 = 0 THEN 5000 ELSE 0 END AS tlen FROM lineitem)"""


def qualities(spark: SparkSession, sf_dir: str, length: int = 16) -> DataFrame:
    """read_id, q: an array of ``length`` qualities (0 to 40 in steps of ten) for each event."""
    digest = lambda i: F.ascii(F.substring(F.md5(F.concat_ws(":", "event_id", i).cast("binary")), 1, 1)) % 5 * 10
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("read_id"), F.transform(F.sequence(F.lit(0), F.lit(length - 1)), digest).alias("q"))


QUALITIES_SQL = """
q_long AS (SELECT event_id AS read_id, i AS pos, ascii(md5(event_id || ':' || i)) % 5 * 10 AS q FROM events, range(16) r(i))"""


def call_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Golden and called variants: two overlapping hashed subsets of the distinct variants."""
    distinct = variants(spark, sf_dir).select("chrom", "pos", "ref", "alt").distinct()
    return distinct.where(in_golden()), distinct.where(in_called())


def hashed_variant(seed: str) -> Column:
    return uniform(seed, F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"))


def in_golden() -> Column:
    return hashed_variant("golden") < 0.8


def in_called() -> Column:
    return hashed_variant("called") < 0.7


def shifted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, block, pos, ref, alt, g of golden variants (g) and calls; some golden ones are called, too, with one more base in front.

    Derived once: each distinct variant says in which sets it is, and the base ahead of it
    comes with its own. Rows are dealt out by block, which holds a variant at a multiple
    of three and the place before it, so groups of a block's rows need no further shuffle.
    """
    rows = variants(spark, sf_dir, front=True).select("chrom", F.floor((F.col("pos") + 1) / BLOCK).alias("block"), "pos", "ref", "alt", "front")
    distinct = rows.repartition("chrom", "block").distinct()
    one = lambda pos, ref, alt, g: F.struct(pos.alias("pos"), ref.alias("ref"), alt.alias("alt"), F.lit(g).alias("g"))
    pos, ref, alt, front = (F.col(c) for c in ("pos", "ref", "alt", "front"))
    # the explode of one value has the draws worked out once
    marked = distinct.select("*", F.inline(F.array(F.struct(in_golden().alias("golden"), in_called().alias("called")))))
    shifted = F.when(F.col("golden") & (pos > 1) & (pos % 3 == 0), one(pos - 1, F.concat(front, ref), F.concat(front, alt), False))
    rows = F.array_compact(F.array(F.when(F.col("golden"), one(pos, ref, alt, True)), F.when(F.col("called"), one(pos, ref, alt, False)), shifted))
    return marked.where("golden or called").select("chrom", "block", F.explode(rows).alias("of")).select("chrom", "block", "of.*")


def uniform_sql(*key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(key)})), 1, 8))::BIGINT / 4294967296.0)"


CALLS_SQL = f"""{VARIANTS_SQL},
d AS MATERIALIZED (SELECT DISTINCT chrom, pos, ref, alt FROM variants),
golden AS MATERIALIZED (SELECT * FROM d WHERE {uniform_sql("'golden'", "chrom", "pos", "ref", "alt")} < 0.8),
called AS MATERIALIZED (SELECT * FROM d WHERE {uniform_sql("'called'", "chrom", "pos", "ref", "alt")} < 0.7)"""
