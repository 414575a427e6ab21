"""tenderlake: procurement-notice analytics as Spark DataFrame operators."""
