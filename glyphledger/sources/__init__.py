"""Reading and writing: images, key-value stores, dictionaries, holdings, reports."""
