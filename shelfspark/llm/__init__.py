"""Operators for building text training corpora. Nothing outside this folder imports it."""
