"""Workflow graphs of relational and text operators on Spark."""
