"""Queries, their envelope, the service over an index, and the workload on the star schema."""
