"""Operators over labelled frames and tables."""
