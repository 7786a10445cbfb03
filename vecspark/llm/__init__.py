"""Training-data operators: license scan, LM scoring, near-dedup, packing, secret scan, token
tables, BM25 search, quality rules, sampled segmentation and substring dedup.

Nothing else in the library imports this subpackage.
"""
