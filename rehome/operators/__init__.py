"""Scopes, maps, lookups and rewrites over estate tables."""
