"""Column helpers and staging shared by the operators."""
