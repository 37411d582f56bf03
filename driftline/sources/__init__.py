"""Readers, audits, manifests and generators of dated series."""
