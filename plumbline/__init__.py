"""Plumbline: listing analytics as composable PySpark DataFrame transformations."""
