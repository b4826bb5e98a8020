"""Docketry: provenance-first document analytics on PySpark."""
