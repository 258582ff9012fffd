"""corpusrank.functions."""
