"""rolescope: job-posting analytics as PySpark DataFrame transformations."""
