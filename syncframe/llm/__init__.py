"""Operations for preparing large text corpora as training data.

Nothing else in the library imports this subpackage.  Every operator takes a DataFrame and names of
its columns, reads whole texts, and returns a DataFrame of its decisions; columns it was not told
about are ignored, so extra columns of any name are harmless.
"""
