"""Registered queries with their reference SQL, over the shared test tables."""
