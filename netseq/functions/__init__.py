"""Column functions; all are built-in expressions evaluated in the JVM."""
