"""Column functions and plan fragments shared by the operators."""
