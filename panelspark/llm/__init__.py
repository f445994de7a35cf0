"""Operators on text and vectors for preparing training data; nothing outside this subpackage imports it."""
