"""Spark-first engine for reconciling travel-expense documents with payment records."""
