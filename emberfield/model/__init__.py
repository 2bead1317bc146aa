"""Fit, draw, predict: additive regressions from sums that Spark computes.

Inference is approximate. A penalised fit finds the posterior mode and a Gaussian around it gives
the draws; there is no sampler and hence there are no chains to diagnose.
"""
