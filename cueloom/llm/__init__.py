"""Operations for large training-data corpora: filtering, de-duplication, scoring, mixing, encoding.

Nothing outside this subpackage imports it.
"""
