"""Presence inference over samples and panels, as Spark DataFrame programs."""
