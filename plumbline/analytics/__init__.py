"""Questions asked of the result history."""
