"""Operations of a training-data pipeline over documents, vectors, pages and conversations.

Nothing outside this subpackage imports it. ``queries`` registers one query per operator.
"""
