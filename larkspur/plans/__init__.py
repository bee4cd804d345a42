"""From statement text to a bound plan, without Spark."""
