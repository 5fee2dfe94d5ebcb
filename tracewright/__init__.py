"""Spark jobs for analysing large corpora of instruction traces and line- or token-oriented text."""
