"""Almagest: dated, evidence-backed analytics expressed as Spark DataFrames."""
