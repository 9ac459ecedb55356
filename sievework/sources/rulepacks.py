"""Packs of rules: archives with a manifest, installed side by side with the version before kept."""

from __future__ import annotations

import hashlib
import hmac
import io
import json
import shutil
import tarfile
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST, BEFORE = "manifest.json", ".before"


def build(path: str, pack_id: str, version: str, rules: dict[str, bytes], listed: list[dict], key: bytes | None = None) -> None:
    """Writes a pack of rule files; listed: id and version of each rule."""
    manifest = {"id": pack_id, "version": version, "rules": listed, "files": {n: hashlib.sha256(d).hexdigest() for n, d in rules.items()}}
    text = json.dumps(manifest, sort_keys=True).encode()
    signed = {"signature.txt": hmac.new(key, text, "sha256").hexdigest().encode()} if key else {}
    with tarfile.open(path, "w:gz") as tar:
        for name, data in {MANIFEST: text, **signed, **rules}.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def _safe(name: str) -> bool:
    parts = PurePosixPath(name)
    return not parts.is_absolute() and ".." not in parts.parts and "\\" not in name and not name.startswith(".")


def install(path: str, store: str, key: bytes | None = None) -> dict:
    """Checks a pack's names, digests and signature, and makes it the current version; the manifest."""
    with tarfile.open(path) as tar:
        files = {m.name: tar.extractfile(m).read() for m in tar.getmembers() if m.isfile()}
    text, signature = files.pop(MANIFEST, b""), files.pop("signature.txt", b"")
    manifest = json.loads(text or b"{}")
    if not all(map(_safe, [*files, str(manifest.get("id", "..")), str(manifest.get("version", ".."))])):
        raise ValueError("rule pack: unsafe name")
    if key and not hmac.compare_digest(hmac.new(key, text, "sha256").hexdigest().encode(), signature):
        raise ValueError("rule pack: signature")
    if {n: hashlib.sha256(d).hexdigest() for n, d in files.items()} != manifest["files"]:
        raise ValueError("rule pack: digests")
    home = Path(store, manifest["id"])
    (home / BEFORE).mkdir(parents=True, exist_ok=True)
    for old in [p for p in home.iterdir() if p.name != BEFORE]:
        shutil.rmtree(home / BEFORE)
        (home / BEFORE).mkdir()
        old.rename(home / BEFORE / old.name)
    for name, data in {MANIFEST: text, **files}.items():
        to = home / manifest["version"] / name
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_bytes(data)
    return manifest


def rollback(store: str, pack_id: str) -> str:
    """Brings back the version before; its name."""
    home = Path(store, pack_id)
    before = sorted((home / BEFORE).iterdir()) if (home / BEFORE).is_dir() else []
    if not before:
        raise ValueError(f"rule pack: no version before of {pack_id}")
    for p in [p for p in home.iterdir() if p.name != BEFORE]:
        shutil.rmtree(p)
    before[0].rename(home / before[0].name)
    return before[0].name


def installed(spark: SparkSession, store: str) -> DataFrame:
    """pack, version, rule_id and rule_version of all current packs."""
    rows = []
    for path in sorted(Path(store).glob(f"*/*/{MANIFEST}")):
        held = json.loads(path.read_text("utf-8"))
        rows += [(held["id"], held["version"], r["id"], r["version"]) for r in held["rules"]] if path.parent.name != BEFORE else []
    return spark.createDataFrame(rows, "pack string, version string, rule_id string, rule_version string")


def conflicts(packs: DataFrame, pack: str) -> DataFrame:
    """Rules of a pack that other packs have too: rule_id, existing_pack, existing_version, new_version."""
    new = packs.where(F.col("pack") == pack).select("rule_id", F.col("rule_version").alias("new_version"))
    return packs.where(F.col("pack") != pack).select("rule_id", F.col("pack").alias("existing_pack"), F.col("rule_version").alias("existing_version")).join(new, "rule_id")
