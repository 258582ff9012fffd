"""corpusrank.plans."""
