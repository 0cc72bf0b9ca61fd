"""What of the operators' results SQL can say: folds, sizes, edits and base spans, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.language_id import op8_language_id
from strandloom.llm.multiset_hash import op3_multiset_hash
from strandloom.llm.pii import op5_personal_data
from strandloom.llm.quality import op2_quality
from strandloom.llm.secret_scan import op4_secret_scan
from strandloom.llm.spelling import CRC_OF_B, CRC_TABLE
from strandloom.llm.token_counts import op10_token_counts
from strandloom.llm.toxicity import op7_toxicity


def quality_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents quality was not learned from, and the rule of the decision."""
    return op2_quality(spark, sf_dir).selectExpr("doc_id", "held_out", "predicted = int(score >= 0.7) and score between 0 and 1 as consistent")


def toxicity_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_toxicity(spark, sf_dir).selectExpr("doc_id", "held_out", "predicted = int(score >= 0.5) and score between 0 and 1 as consistent")


def language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds, and the texts without a letter, whose language can't be told."""
    return op8_language_id(spark, sf_dir).selectExpr("doc_id", "held_out", "lang_pred = 'und' as undetermined")


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_multiset_hash(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def personal_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def token_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each text, and whether its tokens are no more than they and the limit is told by them."""
    return op10_token_counts(spark, sf_dir).selectExpr("doc_id", "n_bytes", "n_tokens <= n_bytes and over_limit = (n_tokens > 2048) as consistent")


def folds(modulus: int, held: int, more: str) -> str:
    return f"WITH {CRC_TABLE}, d AS (SELECT doc_id, text, encode(CAST(doc_id AS VARCHAR)) AS b FROM documents) SELECT doc_id, {CRC_OF_B} % {modulus} = {held} AS held_out, {more} FROM d CROSS JOIN crc"


T = "coalesce(text, '')"
#: Digits of a number in turns from the right: those at odd places doubled, and their own digits added.
LUHN = "list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN d[length(d) - i]::INT ELSE (d[length(d) - i]::INT * 2) // 10 + (d[length(d) - i]::INT * 2) % 10 END)) % 10 = 0"
ORACLES = {
    "quality_folds": folds(4, 2, "true AS consistent"),
    "toxicity_folds": folds(5, 0, "true AS consistent"),
    "language_folds": folds(4, 2, f"NOT regexp_matches({T}, '\\p{{L}}') AS undetermined"),
    "fingerprint_edits": f"""WITH d AS (SELECT doc_id, {T} AS text, CAST(length({T}) AS BIGINT) AS n FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following FROM d)
SELECT doc_id, n AS n_chars, sha256(substr(text, 1, n - n // 2) || substr(following, 1, n // 2)) AS edited_sha256 FROM n""",
    "secret_base_counts": rf"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all({T}, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS BIGINT) AS n_assign,
CAST(len(list_filter(regexp_extract_all({T}, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all({T}, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS BIGINT) AS n_hex FROM documents""",
    "personal_base_counts": rf"""WITH found AS (SELECT doc_id, len(regexp_extract_all({T}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
  list_filter(regexp_extract_all({T}, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: TRY_CAST(p AS HUGEINT))) <= 255) AS ips,
  list_transform(regexp_extract_all({T}, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[ -]', '', 'g')) AS cards,
  list_filter(regexp_extract_all({T}, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15) AS phones FROM documents)
SELECT doc_id, CAST(n_email AS BIGINT) AS n_email, CAST(len(ips) AS BIGINT) AS n_ip, CAST(len(list_filter(cards, lambda d: length(d) BETWEEN 16 AND 19 AND {LUHN})) AS BIGINT) AS n_card, CAST(len(phones) AS BIGINT) AS n_phone FROM found""",
    "token_sizes": f"SELECT doc_id, CAST(strlen({T}) AS BIGINT) AS n_bytes, true AS consistent FROM documents",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (quality_folds, toxicity_folds, language_folds, fingerprint_edits, secret_base_counts, personal_base_counts, token_sizes)}
