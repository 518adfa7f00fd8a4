"""Training-data operators: deduplication, tokenisation, filtering and mixing of text corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
