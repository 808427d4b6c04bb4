"""Column functions: normalisation, identifiers, classifiers. All are built-in expressions, so plans stay in the JVM."""
