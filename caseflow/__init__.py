"""caseflow: Spark-native investigation analytics over evidence, graphs and text."""
