"""Scalar column functions (JVM-side expressions only)."""
