"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from loomspan.llm import decontaminate, exact_dedup, licenses, line_dedup, merkle, mixing, neighbours, passages, periodic, quality, sharding, simhash, tokens

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op10_quality": quality.op10_quality,
    "op11_periodic": periodic.op11_periodic,
    "op12_neighbours": neighbours.op12_neighbours,
    "op13_merkle": merkle.op13_merkle,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_licenses": licenses.op3_licenses,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_sharding": sharding.op5_sharding,
    "op6_simhash": simhash.op6_simhash,
    "op7_passages": passages.op7_passages,
    "op8_mixing": mixing.op8_mixing,
    "op9_tokens": tokens.op9_tokens,
}

SQL = {"op1_line_dedup": line_dedup.SQL, "op13_merkle": merkle.SQL, "op4_exact_dedup": exact_dedup.SQL, "op8_mixing": mixing.SQL}
