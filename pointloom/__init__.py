"""A PySpark-native analytics engine for 3-D point clouds and pose graphs."""
