"""Models and operators on interactions and factors."""
