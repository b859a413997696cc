"""chainlens: wallet segmentation and loyalty analytics on Spark."""
