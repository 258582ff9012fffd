"""corpusrank.streaming."""
