"""Registered queries (with their SQL oracles) and plan guards."""
