"""Compositions of operators into the analyses users run."""
