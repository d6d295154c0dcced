"""Spark-first network screening: rank locations by risk and test the ranking on held-out periods."""
