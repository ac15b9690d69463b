"""DataFrame operators. Every operator takes and returns DataFrames or Columns, parameterised by column names."""
