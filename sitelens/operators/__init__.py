"""Operators over tables: extraction, validation, aggregation, crawling, health, runs."""
