"""Part of strandline; see the README for the map of modules."""
