"""Gistmill: a PySpark-native engine for digests of document sets and the analytics around them."""
