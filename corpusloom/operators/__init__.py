"""Operators over fact, relation, graph and trace tables."""
