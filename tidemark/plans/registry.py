"""All queries of the library by name, and their SQL."""

from tidemark.operators import bootstrap, checks, density, joins, manifold, ml, ordering, paired_bootstrap, scoring, subwords, text_queries, text_vectors, topics
from tidemark.plans import catalog, spikes
from tidemark.sources import cache, records, workbooks
from tidemark.sources import queries as sources
from tidemark.streaming import weekly

QUERIES = {**catalog.QUERIES, **spikes.QUERIES, **text_queries.QUERIES, **checks.QUERIES, **joins.QUERIES, **scoring.QUERIES, **topics.QUERIES, **bootstrap.QUERIES, **paired_bootstrap.QUERIES, **density.QUERIES, **manifold.QUERIES, **ml.QUERIES, **text_vectors.QUERIES, **subwords.QUERIES, **sources.QUERIES, **records.QUERIES, **workbooks.QUERIES, **cache.QUERIES, **ordering.QUERIES, **weekly.QUERIES}
ORACLES = {**catalog.ORACLES, **spikes.ORACLES, **text_queries.ORACLES, **checks.ORACLES, **joins.ORACLES, **scoring.ORACLES, **topics.ORACLES, **density.ORACLES, **sources.ORACLES, **records.ORACLES, **workbooks.ORACLES, **cache.ORACLES, **ordering.ORACLES, **weekly.ORACLES}
