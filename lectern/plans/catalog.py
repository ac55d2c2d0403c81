"""The queries over the tables by name, and their SQL."""

from lectern.plans import answering, ingesting, kernels, resuming, retrieving, scanning, seeding, tracing

PARTS = (retrieving, ingesting, scanning, seeding, resuming, answering, tracing, kernels)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
