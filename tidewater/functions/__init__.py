"""Column-expression library: every function takes and returns ``Column``."""
