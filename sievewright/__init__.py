"""Spark-first analytics over corpora of source code and text documents."""
