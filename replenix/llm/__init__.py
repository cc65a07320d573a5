"""Training-data operators over documents, embeddings, labels and conversations.

Nothing outside this package imports it; its queries are in ``registry``."""
