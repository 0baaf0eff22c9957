"""Whole plans composed from operators."""
