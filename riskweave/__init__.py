"""Behavioural-risk analytics over transaction tables and streams, on Spark."""
