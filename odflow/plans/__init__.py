"""Bindings to the driver's tables, and the queries over them."""
