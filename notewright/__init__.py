"""Symbolic-music corpus analytics as Spark DataFrame operators."""
