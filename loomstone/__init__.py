"""Loomstone: evidence analytics and corpus preparation expressed as Spark plans."""
