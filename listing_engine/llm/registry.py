"""The queries of this package and of the pipeline, with their SQL."""

from __future__ import annotations

import corpus_pipeline
from listing_engine.llm import byte_bpe, decontamination, fingerprints, hard_negatives, language, lexical_search, licenses, minhash, near_duplicates, pii, toxicity, url_filters, warc

_MODULES = (fingerprints, url_filters, byte_bpe, decontamination, licenses, pii, language, warc, near_duplicates, toxicity, lexical_search, minhash, hard_negatives)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
