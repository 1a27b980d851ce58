"""DataFrame operators over histories, trees, diffs, stores and rasters."""
