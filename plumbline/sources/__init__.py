"""Where tables, rules and logged failures come from."""
