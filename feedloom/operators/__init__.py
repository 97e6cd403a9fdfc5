"""DataFrame to DataFrame operators of the feedback engine."""
