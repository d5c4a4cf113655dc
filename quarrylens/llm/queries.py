"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline
from quarrylens.llm import bpe, exact_dedup, html_main, negatives, neighbours, packing, quality, rules, sharding, simhash, spelling, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_html": html_main.op2_html,
    "op3_packing": packing.op3_packing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_quality": quality.op5_quality,
    "op6_simhash": simhash.op6_simhash,
    "op7_warc": warc.op7_warc,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_bpe": bpe.op10_bpe,
    "op11_neighbours": neighbours.op11_neighbours,
    "op12_spelling": spelling.op12_spelling,
    "op13_negatives": negatives.op13_negatives,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op4_exact_dedup": exact_dedup.ORACLE, "op7_warc": warc.ORACLE, "op9_quality_rules": rules.oracle(), "op13_negatives": negatives.ORACLE}
