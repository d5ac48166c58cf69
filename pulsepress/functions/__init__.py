"""Column functions: each takes columns or plain values and returns a Spark column."""
