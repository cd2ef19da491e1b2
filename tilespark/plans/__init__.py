"""Queries over the shared tables with the SQL that checks them."""
