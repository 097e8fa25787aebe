"""The queries of the engine, and the SQL that checks them."""

from tidewater.plans import analytics, retrieval

QUERIES = {**retrieval.QUERIES, **analytics.QUERIES}
SQL = {**retrieval.SQL, **analytics.SQL}
