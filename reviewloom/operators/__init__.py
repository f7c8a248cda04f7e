"""Operators: shaping, bags, features, graphs, ranking, statistics, learning."""
