"""Operators for preparing training corpora (numbered 1-10) and the queries that apply them."""
