"""Household-finance analytics on Spark."""
