"""Personalised ranking as Spark plans."""
