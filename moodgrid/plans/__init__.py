"""Estimators and compositions built from the operators."""
