"""tidegrid: event-windowed tick analytics as plain Spark DataFrame operators."""
