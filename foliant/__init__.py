"""Foliant: document retrieval and conversation analytics as PySpark DataFrame operators."""
