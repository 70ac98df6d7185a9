"""Operators of a training-data pipeline: filter, deduplicate, mix, search and pack documents.

Rules that hold for every operator here:

* a null text counts as an empty text unless the operator says otherwise;
* repeated rows stay repeated rows of the result;
* columns that an operator does not name pass through untouched; a result
  column replaces an input column of the same name.
"""
