"""Column functions; all are built-in expressions unless their name says ``udf``."""
