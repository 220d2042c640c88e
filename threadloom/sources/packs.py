"""What goes in and out as a folder: zipped exports, reports and migration packs. These are small and made on the driver."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tempfile
import zipfile
from collections.abc import Mapping
from pathlib import Path

DATED = re.compile(r"(\d{4}-\d{2}-\d{2})")


def extract_export(archive: str, into: str) -> str:
    """Unpacks a zipped export below `into` and returns its root: the one folder with conversations. Entries that would leave
    the folder are refused; an archive that was unpacked before isn't again."""
    with open(archive, "rb") as f:
        digest = hashlib.file_digest(f, "sha256").hexdigest()
    target = Path(into) / digest[:16]
    if not target.exists():
        Path(into).mkdir(parents=True, exist_ok=True)
        staging = Path(tempfile.mkdtemp(prefix=".unpack-", dir=into))
        try:
            with zipfile.ZipFile(archive) as z:
                for name in z.namelist():
                    if not (staging / name).resolve().is_relative_to(staging.resolve()):
                        raise ValueError(f"an entry leaves the folder: {name}")
                z.extractall(staging)
            os.rename(staging, target)
        finally:
            shutil.rmtree(staging, ignore_errors=True)
    roots = {p.parent for p in target.rglob("conversations*.json")}
    if len(roots) != 1:
        raise ValueError(f"{len(roots)} folders hold conversations; there must be one")
    return str(roots.pop())


def latest_export(root: str) -> str:
    """The folder below root whose name has the latest date."""
    found = [(m[1], p.name) for p in Path(root).iterdir() if p.is_dir() and (m := DATED.search(p.name))]
    if not found:
        raise ValueError("no dated export")
    return str(Path(root) / max(found)[1])


def write_atomic(path: str, content: str) -> None:
    """The file is there whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def publish(staging: str, target: str, sha256: str) -> None:
    """Moves a staged file to its place, unless a file is there: one with the same hash stays, another is an error."""
    with open(staging, "rb") as f:
        if hashlib.file_digest(f, "sha256").hexdigest() != sha256:
            raise ValueError("the staged file has another hash")
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    try:
        os.link(staging, target)  # fails if target exists
    except FileExistsError:
        with open(target, "rb") as f:
            if hashlib.file_digest(f, "sha256").hexdigest() != sha256:
                raise ValueError(f"published artifact conflict: {os.path.basename(target)}") from None
    os.unlink(staging)


def staging_residue(root: str, prefix: str = "staging") -> list[str]:
    """Paths below root, relative and sorted, that unfinished work has left."""
    base = Path(root)
    return sorted(str(p.relative_to(base)) for p in base.rglob("*") if any(x.startswith((prefix, f".{prefix}")) for x in p.relative_to(base).parts))


def write_pack(folder: str, files: Mapping[str, str]) -> dict:
    """Writes text files and a manifest with their hashes; the tree's hash depends on names and contents alone."""
    os.makedirs(folder, exist_ok=True)
    entries = []
    for name in sorted(files):
        if os.path.basename(name) != name:
            raise ValueError("names only")
        write_atomic(os.path.join(folder, name), files[name])
        entries.append({"path": name, "size": len(files[name].encode()), "sha256": hashlib.sha256(files[name].encode()).hexdigest()})
    manifest = {"files": entries, "tree_sha256": hashlib.sha256("".join(f"{e['path']}\0{e['sha256']}\0" for e in entries).encode()).hexdigest()}
    write_atomic(os.path.join(folder, "manifest.json"), json.dumps(manifest, sort_keys=True, indent=2))
    return manifest


def verify_pack(folder: str) -> list[str]:
    """Names of files that differ from the manifest, are missing, or aren't listed."""
    manifest = json.loads(Path(folder, "manifest.json").read_text(encoding="utf-8"))
    listed = {e["path"]: e["sha256"] for e in manifest["files"]}
    there = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(folder).iterdir() if p.name != "manifest.json"}
    return sorted(n for n in listed.keys() | there.keys() if listed.get(n) != there.get(n))


def profile_markdown(groups: list[dict], title: str = "Confirmed profile") -> str:
    """Statements by kind, each with its sources."""
    out = [f"# {title}", ""]
    for kind in sorted({g["kind"] for g in groups}):
        out += [f"## {kind}", ""]
        out += [f"- {g['statement']} ({', '.join(map(str, g['sources']))})" for g in groups if g["kind"] == kind]
        out.append("")
    return "\n".join(out)
