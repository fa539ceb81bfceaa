"""Queries over whole tables, one module for each area, with SQL of the same results."""
