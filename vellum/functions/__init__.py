"""Column functions: text, numbers, labels. All run inside the JVM."""
