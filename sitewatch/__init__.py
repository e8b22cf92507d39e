"""Safety-event analytics and training-data operators on Spark."""
