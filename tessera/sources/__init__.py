"""Readers and writers: listings, manifests, path lists, reports."""
