"""Homomorphic multiset fingerprints of documents, in DataFrame functions alone.

A paragraph (line) hashes to a wide vector: EQUAL lanes of 32 bits from its seeded
XXH64 values, and 2 x BITS lanes that count set bits over the hashes of its word
pairs (the last word has none after it and counts alone). A document's fingerprint is the sum of its paragraphs' vectors, lane by lane,
modulo 2^32 and 2^16. It doesn't depend on the paragraphs' order, and paragraphs
are inserted or deleted by adding or subtracting their vectors. The counting lanes
are random projections of the bag of word pairs, so their cosine tells likeness.
"""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import id_and_text, table

#: Lanes for equality, and packed pairs of counting lanes.
EQUAL, BITS = 8, 31
#: Bits s and s + 31 of a hash, as two counters in a long; no text has 2^31 words.
PAIR = (1 << 31) | 1
WIDE, NARROW = 1 << 32, 1 << 16
#: Rows that a bucket of neighbouring ids holds, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 256, 65_536


def lanes(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` with equal (array of EQUAL longs), units (long) and packed (array of BITS longs).

    ``keys`` identify a text. The rows of a text are exploded and summed where they lie;
    if the input is partitioned by some of the keys, nothing is shuffled.
    """
    paragraph = rows.select(*keys, F.explode(F.split(F.col(text), "\n", -1)).alias("paragraph"))
    words = F.split("paragraph", " ", -1)
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    unit = paragraph.select(*keys, "paragraph", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), pairs)).alias("place", "hash"))
    head = F.col("place") == 0
    whole = [F.xxhash64(F.lit(i), "paragraph") for i in range(EQUAL // 2)]
    halves = [x for h in whole for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(WIDE - 1)))]
    sums = [F.sum(F.when(head, x).otherwise(F.lit(0).cast("long"))).alias(f"e{i}") for i, x in enumerate(halves)]
    sums += [F.sum(F.when(head, F.lit(0).cast("long")).otherwise(F.lit(1).cast("long"))).alias("units")]
    # the head's hash is 0 and counts nothing
    sums += [F.sum(F.shiftright("hash", s).bitwiseAND(F.lit(PAIR))).alias(f"b{s}") for s in range(BITS)]
    return unit.groupBy(*keys).agg(*sums).select(
        *keys,
        F.array(*[F.pmod(f"e{i}", F.lit(WIDE)) for i in range(EQUAL)]).alias("equal"),
        "units",
        F.array(*[f"b{s}" for s in range(BITS)]).alias("packed"),
    )


def counters(packed: Column) -> Column:
    """The 2 x BITS counting lanes, modulo 2^16."""
    return F.flatten(F.transform(packed, lambda p: F.array(p.bitwiseAND(F.lit(NARROW - 1)), F.shiftright(p, 31).bitwiseAND(F.lit(NARROW - 1)))))


def as_text(equal: Column, units: Column, packed: Column) -> Column:
    """The fingerprint as hex digits: equality lanes, word pairs, counting lanes."""
    fixed = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.concat(
        F.array_join(F.transform(equal, lambda x: fixed(x, 8)), ""), fixed(F.pmod(units, F.lit(WIDE)), 8), F.array_join(F.transform(counters(packed), lambda x: fixed(x, 4)), "")
    )


def insert(a: Column, b: Column, modulus: int) -> Column:
    """Lanes of the union of two multisets."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(modulus)))


def delete(a: Column, b: Column, modulus: int) -> Column:
    """Lanes of ``a`` without the multiset ``b``, which it holds."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(modulus)))


def deviations(units: Column, packed: Column) -> Column:
    """Each counting lane less its expected value, half the word pairs."""
    half = F.shiftright(units, 1)
    return F.transform(counters(packed), lambda c: F.pmod(c - half + F.lit(NARROW // 2), F.lit(NARROW)) - F.lit(NARROW // 2))


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Cosine of two fingerprints' deviations, 0 to 1; 1 where ``equal``."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    cosine = F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))
    return F.when(equal, F.lit(1.0)).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)))


def id_buckets(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with key (the id; null: the least long) and bucket, and the number of buckets.

    Buckets are ranges of falling ids with about as many rows each. Each begins with an
    id of the table, so the row that follows a bucket is known beforehand; a copy of it,
    marked ``ghost``, closes the bucket. At most MOST_BUCKETS ids come to the driver.
    """
    d = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n, top = d.agg(F.count(F.lit(1)), F.max("key")).first()
    if not n:
        return d.withColumns({"bucket": F.lit(0).cast("long"), "ghost": F.lit(False)}), 0
    parts = min(MOST_BUCKETS, ceil(n / BUCKET_ROWS))
    cuts = d.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [1.0], max(10_000, 10 * parts))).first()[0]
    heads = sorted({top, *cuts}, reverse=True)
    width = isqrt(len(heads) - 1) + 1
    known = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    reached = lambda xs: F.size(F.filter(xs, lambda h: h >= F.col("key"))).cast("long") - 1
    group = d.withColumn("group", reached(known(heads[::width])))
    within = group.withColumn("bucket", F.col("group") * width + reached(F.slice(known(heads), (F.col("group") * width + 1).cast("int"), F.lit(width)))).drop("group")
    first = F.col("key") == F.element_at(known(heads), (F.col("bucket") + 1).cast("int"))
    places = F.when(first, F.array(F.struct("bucket", F.lit(False).alias("ghost")), F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(heads))).alias("bucket"), F.lit(True).alias("ghost"))))
    places = places.otherwise(F.array(F.struct("bucket", F.lit(False).alias("ghost"))))
    return within.withColumn("place", F.explode(places)).drop("bucket").select("*", "place.bucket", "place.ghost").drop("place"), len(heads)


def edited(text: Column, n: Column, following: Column) -> Column:
    """The last floor(n / 2) signs replaced by the first as many of the following text."""
    return F.concat(F.substring(text, F.lit(1), (n - F.floor(n / 2)).cast("int")), F.substring(following, F.lit(1), F.floor(n / 2).cast("int")))


def fingerprint_with_edit(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text), of its edited text, and their likeness.

    The next document is that with the next smaller id; after the last comes the first.
    A null text is empty; null ids stand below all others; rows with the same id are
    ordered by text. A table of one row follows itself, an empty one gives nothing.
    Other columns are ignored. Texts are shuffled once.
    """
    rows, _ = id_buckets(id_and_text(docs))
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("key").desc(), "text")
    n = F.char_length("text").cast("long")
    placed = rows.select("*", F.row_number().over(order).alias("rank"), F.lead("text").over(order).alias("following"), n.alias("n_chars"))
    placed = placed.withColumn("edited", edited(F.col("text"), F.col("n_chars"), F.coalesce("following", F.lit(""))))
    kind = lambda k, text, sha: F.struct(F.lit(k).alias("kind"), text.alias("text"), sha.alias("sha"))
    plain = kind(0, F.col("text"), F.lit("").cast("binary"))
    changed = kind(1, F.col("edited"), F.unhex(F.sha2("edited", 256)))
    both = placed.select("bucket", "rank", "doc_id", "ghost", "n_chars", F.explode(F.when(F.col("ghost"), F.array(plain)).otherwise(F.array(plain, changed))).alias("of"))
    keys = ["bucket", "rank", "kind", "doc_id", "ghost", "n_chars", "sha"]
    found = lanes(both.select("bucket", "rank", "doc_id", "ghost", "n_chars", "of.*"), keys)
    found = found.select("bucket", "rank", "kind", "doc_id", "ghost", "n_chars", "sha", F.struct("equal", "units", "packed").alias("own"))
    by = Window.partitionBy("bucket").orderBy("rank", "kind")
    seen = found.select("*", F.lead("own", 1).over(by).alias("mine"), F.lead("sha", 1).over(by).alias("mine_sha"), F.lead("own", 2).over(by).alias("other"))
    seen = seen.where((F.col("kind") == 0) & ~F.col("ghost"))
    named = seen.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("mine_sha")).alias("edited_sha256"),
        *[as_text(F.col(f"{c}.equal"), F.col(f"{c}.units"), F.col(f"{c}.packed")).alias(f"{c}_text") for c in ("own", "mine", "other")],
        *[deviations(F.col(f"{c}.units"), F.col(f"{c}.packed")).alias(f"{c}_dev") for c in ("own", "mine", "other")],
    )
    return named.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("own_text").alias("fingerprint"),
        F.col("mine_text").alias("edited_fingerprint"),
        likeness(F.col("own_dev"), F.col("mine_dev"), F.col("own_text") == F.col("mine_text")).alias("near_edited"),
        likeness(F.col("own_dev"), F.col("other_dev"), F.col("own_text") == F.col("other_text")).alias("near_next"),
    )


def op3_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_edit(table(spark, sf_dir, "documents"))
