"""Tessellum: document retrieval, knowledge graphs and corpus preparation as Spark DataFrame plans."""
