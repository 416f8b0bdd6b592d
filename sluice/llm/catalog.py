"""The queries of this subpackage and their SQL."""

from sluice.llm import alignment, archives, centroids, crf, decontam, langid, lattice, minhash, packing, rules, shards, suffixes, tokencounts

_MODULES = (decontam, archives, lattice, rules, crf, suffixes, shards, packing, langid, minhash, alignment, centroids, tokencounts)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
