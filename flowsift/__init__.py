"""Workflow-history jobs on Spark."""
