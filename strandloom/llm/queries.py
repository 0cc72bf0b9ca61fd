"""The queries of the training-data operators, one for each, and what of their results SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import expressible, spelling, vector_codes
from strandloom.llm.byte_bpe import op12_byte_bpe
from strandloom.llm.decontaminate import op1_decontaminate
from strandloom.llm.language_id import op8_language_id
from strandloom.llm.multiset_hash import op3_multiset_hash
from strandloom.llm.packing import op9_pack
from strandloom.llm.pii import op5_personal_data
from strandloom.llm.quality import op2_quality
from strandloom.llm.secret_scan import op4_secret_scan
from strandloom.llm.simhash import op6_simhash
from strandloom.llm.spelling import op13_spelling
from strandloom.llm.token_counts import op10_token_counts
from strandloom.llm.toxicity import op7_toxicity
from strandloom.llm.vector_codes import op11_vector_codes

Query = Callable[[SparkSession, str], DataFrame]
ALL = (op1_decontaminate, op2_quality, op3_multiset_hash, op4_secret_scan, op5_personal_data, op6_simhash, op7_toxicity, op8_language_id, op9_pack, op10_token_counts, op11_vector_codes, op12_byte_bpe, op13_spelling)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in ALL} | expressible.QUERIES


def oracle_sql() -> dict[str, str]:
    return {"op11_vector_codes": vector_codes.ORACLE_SQL, "op13_spelling": spelling.ORACLE_SQL} | expressible.ORACLES
