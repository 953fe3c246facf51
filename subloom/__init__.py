"""subloom: WordPiece text encoding on Spark, as DataFrame expressions and Arrow kernels."""
