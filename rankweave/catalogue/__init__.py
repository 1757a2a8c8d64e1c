"""Named queries over the star-schema tables, each with the SQL that gives the same rows."""

from rankweave.catalogue import aggregates, features, ingest, ranking, signals, sources, streams

MODULES = (sources, aggregates, features, signals, ranking, ingest, streams)

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
