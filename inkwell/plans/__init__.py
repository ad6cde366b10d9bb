"""Whole lifecycles, composed from the operators."""
