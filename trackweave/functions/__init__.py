"""Scalar functions as column expressions, all inside whole-stage code generation."""
