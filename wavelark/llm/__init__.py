"""Training-data operators: one module per operator, their queries in ``queries.py``.

Every operator takes a DataFrame and column names and returns a DataFrame.
Rules that hold for all of them:

* a null text counts as an empty one unless the operator says otherwise;
* an empty table gives an empty result of the same schema;
* other columns of the input, whatever their names, are neither read nor
  returned, so that they can't clash with the operator's own;
* rows that repeat are rows: each gets its own result row.
"""
