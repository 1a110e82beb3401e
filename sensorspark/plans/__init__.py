"""Whole cycles put together from operators."""
