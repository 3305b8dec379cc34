"""Procurement analytics on Spark: operators, views, scores and loads as DataFrame functions."""
