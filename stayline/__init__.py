"""Customer churn and retention analytics on PySpark."""
