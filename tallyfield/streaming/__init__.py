"""Micro-batch jobs around the batch operators."""
