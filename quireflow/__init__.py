"""quireflow: scholarly-corpus analytics as DataFrame-to-DataFrame functions on Spark."""
