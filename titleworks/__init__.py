"""Catalog analytics as Spark jobs: clean, merge, analyse, and recommend titles."""
