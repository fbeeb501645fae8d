"""Operators for building training corpora; self-contained, nothing else imports it."""
