"""Queries over the driver's tables, with the SQL they are compared with."""
