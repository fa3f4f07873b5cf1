"""Table operators: DataFrame in, lazy DataFrame out."""
