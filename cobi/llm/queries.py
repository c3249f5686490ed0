"""Registered queries of the training-data operators: name -> (function, oracle
SQL or None).  Most results hold hashes, trees, tokens or keyed permutations
that SQL cannot express; ``tests/llm`` compares them with brute force."""

import corpus_pipeline
from cobi.llm import (collocations, ctw, decontaminate, doubling_dedup, heavy_light, main_text, merkle, minmax_dedup, packing, pii,
                      quality, search, shards)

QUERIES = {
    "op1_pii_pseudonyms": (pii.query, None),
    "op2_main_text": (main_text.query, None),
    "op3_doubling_dedup": (doubling_dedup.query, doubling_dedup.ORACLE_SQL),
    "op4_decontaminate": (decontaminate.query, decontaminate.ORACLE_SQL),
    "op5_importance_resampling": (quality.query, None),
    "op6_merkle": (merkle.query, None),
    "op7_training_order": (shards.query, None),
    "op8_bin_completion": (packing.query, None),
    "op9_ctw": (ctw.query, None),
    "op10_minmax_dedup": (minmax_dedup.query, minmax_dedup.ORACLE_SQL),
    "op11_toivonen": (collocations.query, collocations.ORACLE_SQL),
    "op12_hybrid_search": (search.query, search.ORACLE_SQL),
    "op13_heavy_light": (heavy_light.query, heavy_light.ORACLE_SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
