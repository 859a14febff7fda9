"""Column functions: text, rules, numbers and vectors, all evaluated in the JVM."""
