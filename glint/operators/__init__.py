"""Operators on observations, samples and scores."""
