"""Spark jobs for catalogue attributes, purchase analysis and recommendation evaluation."""
