"""Operators for training-data corpora: dedup, filtering, tokens, packing, decontamination, chat."""
