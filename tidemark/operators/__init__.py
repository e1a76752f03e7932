"""Operators over offers, listings, catalogs and queues."""
