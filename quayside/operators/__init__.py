"""Operators: split, profile, metrics, features, classifiers, regressors."""
