"""The registered queries: each one a Spark plan beside its check in SQL."""
