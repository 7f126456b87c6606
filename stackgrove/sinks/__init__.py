"""Writers of dumps, graphs, nested documents and logs."""
