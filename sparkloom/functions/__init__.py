"""Column functions. All of them are built-in expressions, so they stay inside
whole-stage code generation and filters on them are pushed down where Spark can."""
