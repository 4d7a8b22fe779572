"""Operators for training data of language models and for similarity at scale; nothing else in curvelake imports them."""
