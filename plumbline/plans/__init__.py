"""Turning a list of rules into DataFrame plans, and running them."""
