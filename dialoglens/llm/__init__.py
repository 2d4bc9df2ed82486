"""Operators for preparing training data: texts, conversations, pages and vectors."""
