"""Column expressions and small driver-side helpers the checks are made of."""
