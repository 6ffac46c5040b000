"""Schema, metapaths and the planning of path counts; no data is touched here."""
