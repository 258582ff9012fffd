"""corpusrank: a Spark-native document retrieval and corpus-processing engine."""
