"""Sluice: describe, run, diagnose and improve data-preparation pipelines as Spark plans."""
