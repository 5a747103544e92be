"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from kvlake.llm import adaptive_scan, html, mixing, mtree, pieces, pii, quality, simhash, toxicity, warc

QUERIES = {
    "op1_simhash_near_dedup": simhash.query,
    "op2_sentencepiece": pieces.query,
    "op3_toxicity": toxicity.query,
    "op4_quality_classifier": quality.query,
    "op5_html_extraction": html.query,
    "op6_exact_top_k": mtree.query,
    "op7_source_mixing": mixing.query,
    "op8_approximate_neighbours": adaptive_scan.query,
    "op9_warc": warc.query,
    "op10_pii": pii.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op6_exact_top_k": mtree.ORACLE, "op7_source_mixing": mixing.ORACLE, "op9_warc": warc.ORACLE}
