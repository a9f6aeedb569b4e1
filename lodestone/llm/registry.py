"""Queries and SQL of the training-data operators."""

import corpus_pipeline
from lodestone.llm import decontaminate, embdedup, langid, mixing, pst, sharding, simhash, tokens, urlfilter, warc

_MODULES = (warc, langid, urlfilter, embdedup, sharding, pst, mixing, decontaminate, simhash, tokens)

QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
