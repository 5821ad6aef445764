"""Dataset-level transforms, each a DataFrame in and a DataFrame out."""
