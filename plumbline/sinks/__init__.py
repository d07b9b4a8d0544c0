"""Where results and failing rows go."""
