"""Tables of items from files, archives, documents, chats, issues and earlier results."""
