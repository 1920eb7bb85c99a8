"""Query operators: DataFrame in, DataFrame out."""
