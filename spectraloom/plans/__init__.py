"""Registered queries, each with its independent SQL where SQL can say it."""
