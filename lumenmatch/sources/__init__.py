"""Listings, post tables, URL tables and the bank store."""
