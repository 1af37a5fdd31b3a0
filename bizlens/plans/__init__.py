"""Registered queries, their SQL checks, and the composed answers."""
