"""Riskweave: code-risk analytics as Spark DataFrame plans."""
