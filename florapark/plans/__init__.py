"""Runnable queries over the standard tables, with their check SQL."""
