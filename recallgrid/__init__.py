"""Recallgrid: analytics over long-lived assistant memory, declared as Spark plans."""
