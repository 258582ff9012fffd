"""corpusrank.operators."""
