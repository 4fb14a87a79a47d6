"""Streaming forms of the tape and console operators."""
