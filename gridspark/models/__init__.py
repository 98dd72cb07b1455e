"""Distributed fitting, validation and scoring of logistic models."""
