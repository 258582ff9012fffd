"""corpusrank.sources."""
