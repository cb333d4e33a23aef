"""Spark-native analytics: evidence retrieval, lift measurement and corpus preparation."""
