"""Queries over the canonical views, their registry and composite jobs."""

from importlib import import_module

MODULES = ("stitch_queries", "shape_queries", "catalogue_queries", "pixel_queries", "file_queries", "stream_queries", "compare_queries", "font_queries", "glyph_queries", "technique_queries", "colour_queries", "rule_queries", "coverage_queries", "layout_queries", "region_graph_queries", "descriptor_queries", "link_queries", "spine_queries", "parity_queries", "census_queries")


def load() -> None:
    """Import the modules that register queries."""
    for name in MODULES:
        import_module(f".{name}", __package__)
