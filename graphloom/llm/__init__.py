"""Operators for training data made of code and text."""
