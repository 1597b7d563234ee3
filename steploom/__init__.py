"""Spark-first reasoning-trace analytics."""
