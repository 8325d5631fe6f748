"""The reports, assembled from operators into one lazy plan each."""
