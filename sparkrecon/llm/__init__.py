"""Operators for preparing training data: ten operators and the pipeline that chains five of them."""
