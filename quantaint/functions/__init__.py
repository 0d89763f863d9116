"""Small column expressions shared by the operators."""
