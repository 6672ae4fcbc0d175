"""flowlens: network-flow analytics as Spark DataFrame operators."""
