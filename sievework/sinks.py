"""Reports: JSON, JSON Lines, SARIF, bills of materials, baselines and audit bundles."""

from __future__ import annotations

import hashlib
import hmac
import io
import json
import tarfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import ranks
from .operators import supply

SCHEMA_VERSION = "1.0.0"
EPOCH = "1970-01-01T00:00:00Z"
FORMATS = ("json", "jsonl", "sarif")


def parse_formats(text: str) -> list[str]:
    """Formats of a comma-parted list, each once, in the order given."""
    names = list(dict.fromkeys(x.strip().lower() for x in text.split(",") if x.strip()))
    if unknown := [n for n in names if n not in FORMATS]:
        raise ValueError(f"unknown format: {', '.join(unknown)}")
    return names


def _finding() -> Column:
    return F.struct("category", "confidence", "cwe_id", "file_path", "fingerprint", F.struct("start_line", "start_col").alias("line_range"), "rule_id", "severity", "snippet")


def finding_lines(findings: DataFrame) -> DataFrame:
    """A JSON document a finding, with keys in order; the body of a report that may be large."""
    return findings.select(F.to_json(_finding()).alias("json"), "file_path", "start_line", "start_col", "rule_id", "fingerprint").orderBy("file_path", "start_line", "start_col", "rule_id", "fingerprint").select("json")


def event_lines(findings: DataFrame, gate: DataFrame | None = None, run: str = "", timestamp: str = EPOCH) -> DataFrame:
    """seq and json of the event log: scan_started, finding_detected, gate_evaluated, scan_completed."""
    def event(df: DataFrame, place: int, kind: str, data: Column, *order: str) -> DataFrame:
        body = F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(kind).alias("event_type"), F.lit(timestamp).alias("timestamp"), F.lit(run).alias("correlation_id"), data.alias("data")))
        keys = F.struct(*[F.col(c).cast("string") if c not in ("start_line", "start_col") else F.format_string("%010d", c) for c in order]) if order else F.struct(F.lit("").alias("x"))
        return df.select(F.lit(place).alias("place"), F.to_json(keys).alias("key"), body.alias("json"))

    one = findings.sparkSession.range(1)
    total = findings.agg(F.count(F.lit(1)).alias("findings"))
    out = event(one, 0, "scan_started", F.struct(F.lit("L1").alias("level"))).unionByName(event(findings, 1, "finding_detected", _finding(), "file_path", "start_line", "start_col", "rule_id", "fingerprint"))
    if gate is not None:
        out = out.unionByName(event(gate, 2, "gate_evaluated", F.struct("result", "breaches")))
    return out.unionByName(event(total, 3, "scan_completed", F.struct("findings")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes an event log in order, in as many files as it takes."""
    lines.orderBy("place", "key").select("json").write.text(path)


#: SARIF levels.
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def sarif_level(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in SARIF_LEVELS.items() for x in p]), severity)


def used_rules(rules: DataFrame, findings: DataFrame) -> DataFrame:
    return rules.join(findings.select("rule_id").distinct(), "rule_id", "left_semi").orderBy("rule_id")


def sarif_results(findings: DataFrame) -> DataFrame:
    """A SARIF result a finding."""
    region = F.struct(F.col("start_line").alias("startLine"), F.greatest(F.col("start_col"), F.lit(1)).alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    body = F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("snippet").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("fingerprints"))
    return findings.select(F.to_json(body).alias("json"), "file_path", "start_line", "start_col", "rule_id", "fingerprint")


def sarif(findings: DataFrame, rules: DataFrame, tool: str = "sieve", version: str = "0.1.0") -> dict:
    """A whole SARIF document; for reports of a size that one file holds."""
    order = ["file_path", "start_line", "start_col", "rule_id", "fingerprint"]
    results = [json.loads(r["json"]) for r in sarif_results(findings).orderBy(*order).toLocalIterator()]
    driver = {"name": tool, "version": version, "rules": [{"id": r["rule_id"], "defaultConfiguration": {"level": SARIF_LEVELS[r["severity"]]}} for r in used_rules(rules, findings).collect()]}
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]}


def write_by_severity(findings: DataFrame, path: str) -> None:
    """One folder of JSON a severity that occurs, and a summary."""
    findings.repartitionByRange("severity", "file_path").write.partitionBy("severity").json(f"{path}/findings")
    findings.groupBy("severity").count().coalesce(1).write.json(f"{path}/summary")


def components(deps: DataFrame) -> DataFrame:
    """ref, type, name, version and purl of distinct dependencies; refs count from 0 in order of name, version and ecosystem."""
    held = supply.distinct_dependencies(deps)
    order = Window.orderBy("name", "version", "ecosystem")  # a project's dependencies
    return held.select((F.row_number().over(order) - 1).alias("n"), "name", "version", "ecosystem").select(F.concat(F.lit("component-"), F.col("n").cast("string")).alias("ref"), F.lit("library").alias("type"), "name", "version", supply.purl(F.col("name"), F.col("version"), F.col("ecosystem")).alias("purl"), "ecosystem")


def cyclonedx(deps: DataFrame, matches: DataFrame | None = None, project: str = "project", timestamp: str = EPOCH) -> dict:
    """A CycloneDX 1.5 document: components, a star of dependencies, and vulnerabilities with the components that they affect."""
    held = components(deps)
    rows = [r.asDict() for r in held.orderBy(F.length("ref"), "ref").collect()]
    out = {
        "bomFormat": "CycloneDX", "specVersion": "1.5", "version": 1, "metadata": {"timestamp": timestamp, "component": {"type": "application", "name": project, "bom-ref": "root"}},
        "components": [{"type": r["type"], "bom-ref": r["ref"], "name": r["name"], "version": r["version"], "purl": r["purl"]} for r in rows], "dependencies": [{"ref": "root", "dependsOn": [r["ref"] for r in rows]}],
    }
    if matches is not None:
        found = matches.join(held.select("name", "version", "ecosystem", "ref"), ["name", "version", "ecosystem"]).groupBy("id").agg(F.array_sort(F.collect_set("ref")).alias("refs"), F.max("cvss_score").alias("score")).orderBy("id").collect()
        out["vulnerabilities"] = [{"id": r["id"], "ratings": [{"score": r["score"]}] if r["score"] is not None else [], "affects": [{"ref": x} for x in r["refs"]]} for r in found]
    return out


def spdx(deps: DataFrame, project: str = "project", timestamp: str = EPOCH) -> dict:
    """An SPDX 2.3 document."""
    rows = components(deps).orderBy(F.length("ref"), "ref").collect()
    packages = [{"SPDXID": f"SPDXRef-{r['ref']}", "name": r["name"], "versionInfo": r["version"], "downloadLocation": "NOASSERTION", "externalRefs": [{"referenceCategory": "PACKAGE-MANAGER", "referenceType": "purl", "referenceLocator": r["purl"]}]} for r in rows]
    root = {"SPDXID": "SPDXRef-root", "name": project, "downloadLocation": "NOASSERTION"}
    relations = [{"spdxElementId": "SPDXRef-DOCUMENT", "relationshipType": "DESCRIBES", "relatedSpdxElement": "SPDXRef-root"}]
    relations += [{"spdxElementId": "SPDXRef-root", "relationshipType": "DEPENDS_ON", "relatedSpdxElement": p["SPDXID"]} for p in packages]
    return {"spdxVersion": "SPDX-2.3", "dataLicense": "CC0-1.0", "SPDXID": "SPDXRef-DOCUMENT", "name": project, "documentNamespace": f"urn:spdx:{project}", "creationInfo": {"created": timestamp, "creators": ["Tool: sievework"]}, "packages": [root, *packages], "relationships": relations}


def baseline_document(findings: DataFrame, scan_id: str = "", created_at: str = EPOCH, engine_version: str = "0.1.0") -> dict:
    prints = [r[0] for r in findings.select("fingerprint").distinct().orderBy("fingerprint").toLocalIterator()]
    return {"schema_version": SCHEMA_VERSION, "scan_id": scan_id, "created_at": created_at, "engine_version": engine_version, "fingerprints": prints, "findings_count": len(prints), "metadata": {}}


def write_bundle(files: dict[str, bytes], path: str, key: bytes | None = None) -> dict[str, str]:
    """An archive of files with a manifest of their digests, signed with a shared key if there is one."""
    manifest = {name: hashlib.sha256(data).hexdigest() for name, data in sorted(files.items())}
    text = json.dumps(manifest, sort_keys=True).encode()
    signed = {"signature.txt": hmac.new(key, text, "sha256").hexdigest().encode()} if key else {}
    with tarfile.open(path, "w:gz") as tar:
        for name, data in {"manifest.json": text, **signed, **files}.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return manifest


def verify_bundle(path: str, key: bytes | None = None) -> list[str]:
    """What is wrong with an archive; empty if it is as it was written."""
    with tarfile.open(path) as tar:
        files = {m.name: tar.extractfile(m).read() for m in tar.getmembers() if m.isfile()}
    text = files.pop("manifest.json", b"")
    signature = files.pop("signature.txt", b"")
    manifest, wrong = json.loads(text or b"{}"), []
    if not text:
        wrong.append("no manifest")
    if key and not hmac.compare_digest(hmac.new(key, text, "sha256").hexdigest().encode(), signature):
        wrong.append("wrong signature")
    wrong += [f"not in the manifest: {n}" for n in sorted(files.keys() - manifest.keys())] + [f"missing: {n}" for n in sorted(manifest.keys() - files.keys())]
    return wrong + [f"changed: {n}" for n in sorted(files.keys() & manifest.keys()) if hashlib.sha256(files[n]).hexdigest() != manifest[n]]


def output_folder(base: str, project: str, timestamp: str) -> Path:
    return Path(base) / project / timestamp


def severity_rank(severity: Column) -> Column:
    return ranks.rank(severity, ranks.SEVERITIES)
