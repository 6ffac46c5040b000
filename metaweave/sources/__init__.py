"""Reading and writing networks, results and archives."""
