"""Operators on text corpora and entity tables for training data; nothing outside this package imports it."""
