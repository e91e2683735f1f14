"""packetloom: features from industrial and IT network captures, as Spark DataFrame operators."""
