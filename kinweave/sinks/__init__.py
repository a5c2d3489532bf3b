"""Writers of networks and datasets."""
