"""Column expressions of genetics; all stay in the JVM."""
