"""Tessera: document import, semantic search and corpus preparation on PySpark."""
