"""Queries over the driver's tables, each beside the SQL it has to agree with."""
