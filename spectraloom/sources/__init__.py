"""Readers and writers for the text formats the tables come in."""
