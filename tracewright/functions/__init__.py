"""Column expressions over log lines, token arrays and scores."""
