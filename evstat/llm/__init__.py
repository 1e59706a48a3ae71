"""Operators of a training-data pipeline over documents, pages, vectors and chats.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
