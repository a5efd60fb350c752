"""DataFrame to DataFrame operators; column names are arguments, nothing is collected."""
