"""Training-data operators: tokenising, deduplication, scans, filters, sharding and packing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
