"""Declarative composition of operators (Q1) and the registered workloads."""
