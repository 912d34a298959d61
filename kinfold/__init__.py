"""Grouped ("clustered") tabular analytics on Spark DataFrames.

Rows come in clusters (papers, suppliers, users).  The package cleans them,
resolves cluster identity, removes duplicates, weights, splits by cluster,
scores out of cluster, audits leakage and compares methods.  Every operator is
a ``DataFrame -> DataFrame`` function that takes column *names*.
"""
