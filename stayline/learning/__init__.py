"""Churn models on MLlib."""
