"""Operators over corpora, decisions, scores, votes, vectors and resamples."""
