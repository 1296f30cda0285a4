"""Web-corpus section analytics on Spark: pages in, clean categorised sections out."""
