"""Training-data operators: ten batch operators over documents, embeddings and conversations.

Nothing outside this package imports it; ``queries.py`` holds the registered queries.
"""
