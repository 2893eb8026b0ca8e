"""Readers and writers of the tables a run takes and makes."""
