"""Spark jobs over chat, prediction and agent-trajectory tables."""
