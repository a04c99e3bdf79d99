"""Column functions. Everything here returns a Column and stays in the JVM."""
