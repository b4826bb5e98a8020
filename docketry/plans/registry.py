"""All queries of the reference's operators by name, and their SQL."""

from docketry.plans import evaluation_queries, linked_queries, recipe_queries, scoring_queries, text_queries, tree_queries, version_queries

QUERIES = {**version_queries.QUERIES, **text_queries.QUERIES, **evaluation_queries.QUERIES, **scoring_queries.QUERIES, **tree_queries.QUERIES, **recipe_queries.QUERIES, **linked_queries.QUERIES}
ORACLES = {**version_queries.ORACLES, **text_queries.ORACLES, **evaluation_queries.ORACLES, **scoring_queries.ORACLES, **tree_queries.ORACLES, **recipe_queries.ORACLES, **linked_queries.ORACLES}
