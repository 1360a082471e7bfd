"""Scalar functions: scores of rules and codecs of symbols."""
