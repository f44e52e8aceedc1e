"""Spark-native article ranking and paper-text engine."""
