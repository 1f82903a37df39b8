"""Cadastra: building-footprint analytics expressed as Spark DataFrame plans."""
