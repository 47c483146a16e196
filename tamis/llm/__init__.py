"""Operations for training-data pipelines over documents, pages and conversations.

Each module is one operator with a general interface; :mod:`tamis.llm.queries`
holds the registered queries. Nothing outside this subpackage imports it.
"""
