"""Branchable analytics on Spark."""
