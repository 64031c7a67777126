"""Whole copy runs, and the queries this package registers."""
