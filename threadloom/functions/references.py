"""References to assets inside a message's payload, at any depth (a UDTF, as the depth isn't bounded)."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Lists of pointers by the name of their field, and the kind that each entry gets.
POINTER_LISTS = {"frames_asset_pointers": "frames_asset_pointer", "asset_pointer_links": "asset_pointer_link"}


def pointers(value: object, path: str) -> Iterator[tuple[str, str, str]]:
    """(kind, reference, path), in document order; an explicit stack, so that deep payloads don't exhaust the interpreter's."""
    todo: list[tuple[object, str]] = [(value, path)]
    while todo:
        at, where = todo.pop()
        if isinstance(at, list):
            todo += [(x, f"{where}[{i}]") for i, x in reversed(list(enumerate(at)))]
        elif isinstance(at, str):
            kind = where.rpartition(".")[2]
            if kind.endswith("asset_pointer"):
                yield kind, at, where
        elif isinstance(at, dict):
            ahead = []
            for name, item in at.items():
                own = f"{where}.{name}"
                if name in POINTER_LISTS and isinstance(item, list):
                    ahead += [((POINTER_LISTS[name], x), f"{own}[{i}]") for i, x in enumerate(item) if isinstance(x, str)]
                elif name.endswith("asset_pointer") and isinstance(item, dict) and isinstance(item.get("asset_pointer"), str):
                    ahead.append(((name, item["asset_pointer"]), own))
                elif isinstance(item, (dict, list)) or name.endswith("asset_pointer"):
                    ahead.append((item, own))
            todo += ahead[::-1]
        elif isinstance(at, tuple):
            yield at[0], at[1], where


def references_of(message: dict) -> list[tuple[str, str, str]]:
    """Pointers in the content, then in the content references, then attachments by file_id or id."""
    metadata = message.get("metadata") if isinstance(message.get("metadata"), dict) else {}
    out = list(pointers(message.get("content"), "content")) + list(pointers(metadata.get("content_references"), "metadata.content_references"))
    attached = metadata.get("attachments")
    for i, item in enumerate(attached if isinstance(attached, list) else []):
        if isinstance(item, dict):
            name = "file_id" if isinstance(item.get("file_id"), str) else "id"
            if isinstance(item.get(name), str):
                out.append((f"attachment_{name}", item[name], f"metadata.attachments[{i}]"))
    return out


@udtf(returnType="ordinal int, kind string, reference string, path string")
class AssetReferences:
    def eval(self, payload: str):
        if payload:
            for i, (kind, reference, path) in enumerate(references_of(json.loads(payload))):
                yield i, kind, reference, path


def register(spark: SparkSession) -> None:
    """Makes asset_references(payload) known to SQL, for lateral joins."""
    spark.udtf.register("asset_references", AssetReferences)
