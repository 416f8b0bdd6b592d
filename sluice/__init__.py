"""Spark-native cleaning, sharding, searching and analysis of large tables."""
