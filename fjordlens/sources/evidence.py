"""Evidence of runs: staged, listed with sizes and hashes, judged, promoted by one rename, and checked again after that.

A run writes its artifacts into a stage beside its place. ``finalize`` lists every file with its size and SHA-256 in ``inventory.json``
and states in ``run.json`` how the run ended: Complete, Hold (with reasons) or Failed. ``promote`` moves a complete stage to
its place, once; ``problems`` compares a stage or a published run with its inventory, file by file and nothing more or less.
Works on any file system of the session; hashes are taken while streaming.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

STATES = ("Running", "Complete", "Hold", "Failed")
IDENTITY = ("candidate_id", "candidate_config_id", "workload_id", "corpus_id", "run_id")  # fixed names of the format
LISTS = ("inventory.json", "run.json")


class EvidenceError(ValueError):
    pass


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, value: dict, again: bool = False) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, again)
    out.write(bytearray((json.dumps(value, sort_keys=True) + "\n").encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise EvidenceError(f"{path} is missing")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def files(spark: SparkSession, at: str) -> dict[str, dict]:
    """Path within the folder to size and hash, for every file but the lists themselves and checksums of the file system."""
    fs, root = _fs(spark, at)
    root = fs.makeQualified(root)
    found, each = {}, fs.listFiles(root, True)
    while each.hasNext():
        f = each.next()
        name = f.getPath().toString()[len(root.toString()) + 1 :]
        last = name.rsplit("/", 1)[-1]
        if name in LISTS or last.startswith(".") and last.endswith(".crc"):
            continue
        stream = fs.open(f.getPath())
        try:
            found[name] = {"bytes": f.getLen(), "sha256": spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)}
        finally:
            stream.close()
    return found


def stage(spark: SparkSession, place: str, identity: dict[str, str]) -> str:
    """A new stage for a run; its place must be free."""
    if identity.keys() != set(IDENTITY) or not all(isinstance(v, str) and v for v in identity.values()):
        raise EvidenceError("identity")
    fs, p = _fs(spark, place)
    if fs.exists(p):
        raise FileExistsError(place)
    at = f"{place}._staging-{uuid.uuid4().hex}"
    _put(spark, f"{at}/run.json", {"evidence_schema_version": 1, "state": "Running", "reasons": [], **identity})
    return at


def finalize(spark: SparkSession, at: str, required: list[str], reasons: list[str] | None = None, failed: bool = False) -> dict:
    """Closes a stage: Failed if the run broke, Hold if there are reasons or a required artifact is missing, else Complete."""
    run = _get(spark, f"{at}/run.json")
    if run["state"] != "Running":
        raise EvidenceError(f"the stage is {run['state']}")
    found = files(spark, at)
    missing = [f"missing: {r}" for r in required if not any(n == r or n.startswith(f"{r}/") for n in found)]
    why = [*(reasons or []), *missing]
    run |= {"state": "Failed" if failed else "Hold" if why else "Complete", "reasons": why}
    _put(spark, f"{at}/inventory.json", found)
    _put(spark, f"{at}/run.json", run, again=True)
    return run


def problems(spark: SparkSession, at: str) -> list[str]:
    """What differs from the inventory: files that lack, are more, or have another size or hash; and a state that is not final."""
    run, listed, found = _get(spark, f"{at}/run.json"), _get(spark, f"{at}/inventory.json"), files(spark, at)
    out = [] if run.get("state") in STATES[1:] else ["state"]
    out += [f"lacks: {n}" for n in sorted(listed.keys() - found.keys())] + [f"more: {n}" for n in sorted(found.keys() - listed.keys())]
    return out + [f"differs: {n}" for n in sorted(listed.keys() & found.keys()) if listed[n] != found[n]]


def promote(spark: SparkSession, at: str, place: str) -> None:
    """Moves a complete and unchanged stage to its place; never over another run."""
    if _get(spark, f"{at}/run.json")["state"] != "Complete":
        raise EvidenceError("the stage is not complete")
    if wrong := problems(spark, at):
        raise EvidenceError(f"the stage has changed: {wrong}")
    fs, to = _fs(spark, place)
    if fs.exists(to):
        raise FileExistsError(place)
    if not fs.rename(_fs(spark, at)[1], to):
        raise OSError(f"cannot rename to {place}")
