"""Column-level functions (JVM-side expressions) and the few Arrow-batched helpers."""
