"""Operators over relations: path counts, diffusion, permutation, degree groups."""
