"""Training-data operators: one module per operator, queries in ``llm_queries``.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
