"""Relational and order-dependent operators over frame, scene and finding tables."""
