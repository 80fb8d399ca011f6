"""Column expressions: pose algebra, camera imaging and capture planning."""
