"""Streams of words: the stateless operators run unchanged on them."""

from helixmill.streaming.decode import decode_stream

__all__ = ["decode_stream"]
