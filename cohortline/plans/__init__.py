"""Whole pipelines in the layout of the public inputs they are made for."""
