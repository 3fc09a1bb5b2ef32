"""overlook: terrain-visibility, site-selection and corpus operators as PySpark jobs."""
