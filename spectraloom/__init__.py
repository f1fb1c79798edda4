"""Proteomics, interaction and network analytics as PySpark DataFrame operators."""
