"""Tables, partition layouts, file listings and storage formats."""
