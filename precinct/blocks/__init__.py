"""Reusable distributed building blocks: materialisation, components, ranks, band joins, grids."""
