"""Linkstone: record linkage and corpus preparation expressed as Spark DataFrame plans."""
