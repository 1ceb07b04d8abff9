"""Scalar and distribution functions shared by the operators."""
