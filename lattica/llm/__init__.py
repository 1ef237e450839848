"""Training-data pipeline operators (independent of the mesh engine)."""
