"""Operators for preparing training data at scale; nothing else in tessera imports this."""
