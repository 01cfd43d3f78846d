"""Training-data operators: token files, mixing, decontamination, URL rules,
vector search, language id, chat windows, secret scans, near duplicates, shards.

Each module holds one operator with a general interface; ``queries.py`` derives
the registered ``opN_*`` results from them.  Nothing outside imports this
subpackage except the guarded block of ``__spark_entry__.py`` and
``corpus_pipeline.py``.
"""
