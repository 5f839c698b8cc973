"""Spark-native analytics for financial news and market data."""
