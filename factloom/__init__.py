"""Fact-based source-code analysis as PySpark DataFrame programs."""
