"""Registered queries, the SQL they must agree with, and the inputs both derive."""
