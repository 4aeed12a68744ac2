"""Adapters from star-schema tables and the registered queries."""
