"""Spark-native analytics over phased genotype matrices."""
