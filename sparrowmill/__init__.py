"""Building and evaluating multiple-choice question data on Spark."""
