"""Kinweave: entity resolution and corpus preparation as Spark SQL/DataFrame plans."""
