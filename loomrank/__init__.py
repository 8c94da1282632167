"""loomrank: a PySpark-native engine for vector pairing, pair mining and ranking evaluation."""
