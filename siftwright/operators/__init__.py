"""Relational and grouped operators over messages, documents and request logs."""
