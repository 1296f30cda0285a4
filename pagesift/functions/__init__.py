"""Column functions: every one maps Columns to a Column and runs on the JVM."""
