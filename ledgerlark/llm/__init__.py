"""Training-data operators: each module holds one operator on Spark DataFrames.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
