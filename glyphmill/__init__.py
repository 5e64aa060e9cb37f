"""Typographic normalisation of document tables, expressed as Spark columns."""
