"""skein: source-code relationship graphs built and queried with Spark."""
