"""Registered queries over the shared test tables and the SQL each one must equal."""
