"""DataFrame operators: each takes DataFrames or Columns and returns them, and starts no job unless it says so."""
