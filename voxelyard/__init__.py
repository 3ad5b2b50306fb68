"""A PySpark-native engine for labelled voxel volumes."""
