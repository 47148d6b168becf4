"""reelgrain: Spark-native analytics over ordered media measurements and labelled feature datasets."""
