"""Spark-first rule, question and consistency analytics."""
