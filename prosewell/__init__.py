"""prosewell: a Spark-native text audit engine and corpus toolkit."""
