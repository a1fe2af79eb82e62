"""Ledgerwake: Spark operators for large event histories and two-party interaction panels."""
