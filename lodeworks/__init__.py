"""Lodeworks: a PySpark-native analytics engine for software supply-chain facts."""
