"""They enter hashes, so results depend on each of their characters. Texts among them are read from the
corpus's data file."""

import json
import pkgutil


def _data(name: str) -> dict:
    return json.loads(pkgutil.get_data("fjordlens.sources", name))


_CORPUS = _data("corpus_v1.json")

# The domain of the sample's hash; those of the workload stand in its contract.
SAMPLE_DOMAIN = _CORPUS["sampleDomain"]
MISS_PREFIX = _CORPUS["missPrefix"]

# The sample: hash mod 1000 below 25.
SAMPLE_MODULUS = 1000
SAMPLE_BELOW = 25

# FNV-1a with 64 bits.
FNV_BASIS = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3

# Bounds of traversals and time limits in seconds.
MAX_DEPTH = 3
VISITED_GUARD = 5000
LIMIT_POINT = 5.0
LIMIT_G1 = 30.0
LIMIT_G2 = 120.0
DEGREE_OVERFLOW = 10_000
HIGH_DEGREE = 500
PROBE_HINTS = 200
