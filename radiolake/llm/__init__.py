"""Preparing text and captures of the network knowledge base for model training.

Nothing else in the library imports this package; its queries and their SQL are
in ``queries``, the chain of stages is ``corpus_pipeline.py`` at the top.
"""
