"""Registered queries: each a plan over the tables, with the SQL it must agree with."""
