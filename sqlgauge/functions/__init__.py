"""Column-expression functions (JVM-side; no Python UDF in any of them)."""
