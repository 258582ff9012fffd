"""Operators for preparing text collections as training data. Nothing outside this subpackage imports it."""
