"""Registered queries of the corpus operators: name -> (query, DuckDB SQL or None).

Each query applies its operator with production parameters to the whole table.  Where SQL
cannot express an operator, tests/llm holds it against a brute-force version.
"""

from __future__ import annotations

from trackyard.llm import (op1_substring, op2_decontaminate, op3_quality, op4_secrets, op5_toxicity, op6_repetition,
                           op7_katz, op8_simhash, op9_pii, op10_packing, op11_whitening, op12_negatives,
                           op13_urls)

QUERIES = {
    "op1_substring_dedup": (op1_substring.query, None),
    "op2_decontaminate": (op2_decontaminate.query, None),
    "op3_quality": (op3_quality.query, None),
    "op4_secrets": (op4_secrets.query, None),
    "op5_toxicity": (op5_toxicity.query, None),
    "op6_repetition": (op6_repetition.query, None),
    "op7_katz": (op7_katz.query, None),
    "op8_simhash": (op8_simhash.query, None),
    "op9_pii": (op9_pii.query, None),
    "op10_packing": (op10_packing.query, None),
    "op11_whitening": (op11_whitening.query, None),
    "op12_hard_negatives": (op12_negatives.query, op12_negatives.ORACLE_SQL),
    "op13_url_filters": (op13_urls.query, op13_urls.oracle()),
}
