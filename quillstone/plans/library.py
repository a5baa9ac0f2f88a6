"""Imports every module that registers queries."""

from quillstone.plans import files, finance, graph_learning, graphs, pipelines, retrieval, texts  # noqa: F401
