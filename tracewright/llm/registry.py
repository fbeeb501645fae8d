"""All queries of the subpackage, with the SQL of those that SQL can express."""

from tracewright.llm import conversation_repair, decontaminate, exact_dedup, hard_negatives, hilbert_shards, language_id, license_scan, ngram_join, packing, simhash, token_files, toxicity, url_filter

MODULES = [token_files, toxicity, language_id, exact_dedup, packing, license_scan, decontaminate, url_filter, ngram_join, hilbert_shards, simhash, conversation_repair, hard_negatives]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
