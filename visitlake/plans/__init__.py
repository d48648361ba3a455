"""Registered queries (``registry``) and their independent SQL (``oracle``)."""
