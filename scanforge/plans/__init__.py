"""Composed scan plans and the registered queries (Spark + oracle SQL)."""
