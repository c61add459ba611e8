"""Lagrangian particle analytics on Spark."""
