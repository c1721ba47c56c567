"""Column-level building blocks; each returns a Column and stays in the JVM."""
