"""Spark-native evaluation and corpus analytics: DataFrame-to-DataFrame operators that Catalyst plans."""
