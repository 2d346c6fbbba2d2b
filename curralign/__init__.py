"""Curriculum alignment analytics expressed as Spark DataFrame plans."""
