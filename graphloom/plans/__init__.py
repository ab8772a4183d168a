"""Whole computations composed from the operators: graphs, models and diagram lines."""
