"""Column expressions and the few DataFrame primitives shared by the operators."""
