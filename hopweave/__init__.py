"""Spark engine for sampled graph computation: tables in, tables out."""
