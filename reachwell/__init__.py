"""Catchment accessibility analytics as Spark DataFrame operators."""
