"""DataFrame operators: reconciling, merging, chunking, searching, enriching."""
