"""Groundwork: document-grounding analytics as DataFrame -> DataFrame functions on Spark."""
