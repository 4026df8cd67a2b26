"""Plane geometry as relations: points, polygon edges, grid cells and scanline spans.

A polygon is a set of edge rows ``(geo_id, x1, y1, x2, y2)``; the even-odd rule gives
holes, several parts and self-crossings a defined meaning.
"""
