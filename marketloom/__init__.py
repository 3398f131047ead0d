"""Listing-market analytics on Spark."""
