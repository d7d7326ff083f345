"""Lodestone: document analytics on Spark."""
