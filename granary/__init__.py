"""Spark-first analytics over claim documents, ledgers, events and text corpora."""
