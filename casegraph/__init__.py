"""Case-file analytics over Spark: every case at once, as DataFrame transformations."""
