"""Registered queries over the shared test tables, each with its SQL counterpart."""
