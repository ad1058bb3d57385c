"""Workload contracts: strict JSON to frozen values. Anything unknown, missing, repeated or out of range is an error."""

from __future__ import annotations

import hashlib
import json
import pkgutil
from dataclasses import dataclass

OPERATIONS = ("S1", "S2", "S3", "S4", "S5", "G1")
MODES = ("sha256-ranked-sample", "all-eligible", "generated-miss", "degree-rank-500")


class ContractError(ValueError):
    pass


@dataclass(frozen=True)
class Stratum:
    operation: str
    stratum: str
    mode: str
    count: int
    expected: int | None = None
    fanout: tuple[int, int | None] | None = None


@dataclass(frozen=True)
class Contract:
    strata: tuple[Stratum, ...]
    tail: tuple[Stratum, ...]
    g2: tuple[tuple[str, int], ...]
    max_depth: int
    guard: int
    limits: tuple[tuple[str, int], ...]
    selection_domain: str
    concept_miss_domain: str
    lexical_miss_domain: str
    miss_language: str
    image: bytes

    def needs(self, *operations: str) -> dict[str, int | None]:
        """Probes of each stratum of these operations by name; None where all eligible ones are taken."""
        return {f"{s.operation}/{s.stratum}": None if s.mode == "all-eligible" else s.count for s in self.strata if s.operation in operations}


#: Format names of a contract file (fixed by the format).
WORDS = ("schema", "selectionDomain", "conceptMissDomain", "lexicalMissDomain", "missLanguage", "lexicalKeySemantics", "orderingAlgorithm", "orderingInterleave", "percentileAlgorithm")
NUMBERS = (
    "workloadContractVersion", "generatorVersion", "canonicalEncodingVersion", "multisetFoldVersion", "servingRepetitions", "openRepetitions", "analyticalRepetitions",
    "buildRepetitions", "timeoutPointOperationSeconds", "timeoutG1StartSeconds", "timeoutG2BatchSeconds", "timeoutAnalyticalSeconds", "timeoutBuildSeconds",
    "maxDepth", "visitedNodeGuard", "g2BatchConcepts",
)
#: What this version of the format supports.
SUPPORTED = {
    "workloadContractVersion": 1, "generatorVersion": 1, "canonicalEncodingVersion": 1, "multisetFoldVersion": 1, "lexicalKeySemantics": "raw-exact-lang-value",
    "orderingAlgorithm": "sha256-rank", "orderingInterleave": "round-robin-stratum-order", "percentileAlgorithm": "linear-interpolated-n-minus-1-v1", "reportP999": False,
}


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ContractError("a key occurs twice")
    return out


def _take(raw: dict, kinds: dict, optional: dict | None = None) -> dict:
    optional = optional or {}
    if not isinstance(raw, dict):
        raise ContractError("an object was expected")
    if extra := raw.keys() - kinds.keys() - optional.keys():
        raise ContractError(f"unknown fields: {sorted(extra)}")
    if missing := kinds.keys() - raw.keys():
        raise ContractError(f"missing fields: {sorted(missing)}")
    for k, v in raw.items():
        kind = (kinds | optional)[k]
        if not isinstance(v, kind) or isinstance(v, bool) and kind is not bool:
            raise ContractError(f"{k} is of another type")
    return raw


def _stratum(raw: dict) -> Stratum:
    r = _take(
        raw,
        {"operation": str, "stratum": str, "selectionMode": str, "measuredCount": int},
        {"expectedEligibleCount": int, "fanoutMin": int, "fanoutMax": (int, type(None))},
    )
    if r["operation"] not in OPERATIONS or r["selectionMode"] not in MODES or r["measuredCount"] < 1:
        raise ContractError(f"{r['operation']}/{r['stratum']}: unknown operation or mode, or no count")
    low, high = r.get("fanoutMin"), r.get("fanoutMax")
    if low is not None and (low < 1 or high is not None and high < low):
        raise ContractError(f"{r['operation']}/{r['stratum']}: empty fanout range")
    return Stratum(
        r["operation"], r["stratum"], r["selectionMode"], r["measuredCount"], r.get("expectedEligibleCount"), (low, high) if low is not None else None
    )


def parse(text: str) -> Contract:
    try:
        raw = json.loads(text, object_pairs_hook=_unique)
    except json.JSONDecodeError as e:
        raise ContractError(str(e)) from e
    lists = ("strata", "correctnessOnly", "g2Strata")
    kinds = dict.fromkeys(WORDS, str) | dict.fromkeys(NUMBERS, int) | dict.fromkeys(lists, list) | {"reportP999": bool, "fullPassWarmup": bool}
    raw = _take(raw, kinds)
    if low := [k for k in NUMBERS if raw[k] < 1]:
        raise ContractError(f"not positive: {low}")
    if other := [k for k, v in SUPPORTED.items() if raw[k] != v]:
        raise ContractError(f"not supported: {other}")
    strata, tail = (tuple(map(_stratum, raw[k])) for k in ("strata", "correctnessOnly"))
    names = [(s.operation, s.stratum) for s in strata + tail]
    if len(set(names)) != len(names):
        raise ContractError("a stratum occurs twice")
    for s in strata + tail:
        if (s.mode == "all-eligible") != (s.expected is not None) or s.mode == "all-eligible" and s.expected != s.count:
            raise ContractError(f"{s.operation}/{s.stratum}: the expected number belongs to strata that are taken whole, and equals their count")
    _contiguous([s for s in strata if s.operation == "S2" and s.mode != "generated-miss"])
    g2 = tuple((r["stratum"], r["count"]) for r in (_take(x, {"stratum": str, "count": int}) for x in raw["g2Strata"]))
    if sum(n for _, n in g2) != raw["g2BatchConcepts"]:
        raise ContractError("the G2 strata do not add up to the batch")
    limits = tuple((k, raw[k]) for k in NUMBERS if k.startswith("timeout"))
    if len(dict(g2)) != len(g2):
        raise ContractError("a G2 stratum occurs twice")
    domains = (raw[k] for k in ("selectionDomain", "conceptMissDomain", "lexicalMissDomain", "missLanguage"))
    return Contract(strata, tail, g2, raw["maxDepth"], raw["visitedNodeGuard"], limits, *domains, _image(raw, strata, tail, g2))


def _coded(*values: str | int | bool | bytes) -> bytes:
    """Values one after the other: texts and bytes with their length in four bytes, numbers in eight, flags in one."""
    out = b""
    for v in values:
        if isinstance(v, bool):
            out += bytes([v])
        elif isinstance(v, int):
            out += v.to_bytes(8, "big", signed=True)
        else:
            v = v.encode() if isinstance(v, str) else v
            out += len(v).to_bytes(4, "big") + v
    return out


def _image(raw: dict, strata: tuple[Stratum, ...], tail: tuple[Stratum, ...], g2: tuple[tuple[str, int], ...]) -> bytes:
    """What a contract says, in bytes, however its file is laid out: its plain values in the order of the format, then the
    strata; -1 stands for what a stratum does not have."""
    names = [WORDS[0], *NUMBERS[:4], *WORDS[1:], "reportP999", "fullPassWarmup", *NUMBERS[4:]]
    out = _coded(*(raw[n] for n in names))
    for s in strata + tail:
        low, high = s.fanout or (None, None)
        out += _coded(s.operation, s.stratum, s.mode, s.count, *(-1 if x is None else x for x in (low, high, s.expected)))
    return out + b"".join(_coded(*x) for x in g2)


def identity(contract: Contract, corpus_id: str, artifacts: dict[str, str], fixture_sha256: str) -> str:
    """The id of a workload: a hash of the contract's image, the corpus, its artifacts (name to hash) by name, and the anchors."""
    parts = [contract.image, corpus_id, *(x for pair in sorted(artifacts.items()) for x in pair), fixture_sha256]
    return hashlib.sha256(_coded(*parts)).hexdigest()


def _contiguous(strata: list[Stratum]) -> None:
    """The fanout ranges of S2 are one partition of 1 to infinity."""
    if any(s.fanout is None for s in strata):
        raise ContractError("a stratum of S2 has no fanout range")
    at = 1
    for s in sorted(strata, key=lambda s: s.fanout[0]):
        low, high = s.fanout
        if at is None or low != at:
            raise ContractError(f"S2/{s.stratum}: its range does not begin where the one before ends")
        at = None if high is None else high + 1
    if at is not None:
        raise ContractError("no range of S2 is open")


def workload(name: str = "workload_contract_v1.json") -> Contract:
    """The contract of the full plan, kept beside this file, or a smaller one."""
    return parse(pkgutil.get_data("fjordlens.sources", name).decode())


def verdict(contract: Contract, pools: dict[str, int]) -> tuple[str, list[str]]:
    """GO, or HOLD with the pools that are too small or not of the expected size."""
    why = []
    for s in contract.strata:
        name, have = f"{s.operation}/{s.stratum}", pools.get(f"{s.operation}/{s.stratum}", 0)
        if s.mode == "generated-miss":
            continue
        if s.mode == "all-eligible":
            if have != s.expected:
                why.append(f"{name}: {have} eligible, {s.expected} expected")
        elif have < s.count:
            why.append(f"{name}: {have} eligible, {s.count} needed")
    return ("HOLD" if why else "GO"), why
