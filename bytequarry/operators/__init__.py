"""Byte operators: transforms, coders, tournament, chunking, parity, ciphers, archive steps."""
