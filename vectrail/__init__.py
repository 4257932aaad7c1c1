"""Hierarchical nearest-neighbour classification and embedding datasets on Spark."""
