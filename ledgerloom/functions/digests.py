"""The numbers of ``uniform`` for many replicates inside tasks."""

from __future__ import annotations

from hashlib import sha256

import numpy as np


def uniforms(head: str, tails: list[bytes]) -> np.ndarray:
    """The number in [0, 1) of ``uniform`` for each message of the head, with the bar that ends it, and a tail."""
    start = head.encode()
    digests = np.frombuffer(b"".join([sha256(start + t).digest() for t in tails]), ">u8")[::4]
    return (digests >> np.uint64(16)).astype(float) / float(1 << 48)
