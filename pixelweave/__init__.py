"""Image-analysis and corpus jobs for Spark: every public function takes and returns DataFrames."""
