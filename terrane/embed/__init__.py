"""Two-dimensional layouts by chunk-parallel and by global t-SNE."""
